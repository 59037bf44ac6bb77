"""SQL fragments for the checks that a second engine runs on the same tables."""

CLEAN_PATH = "array_to_string(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/')"


def current(table: str, key: str) -> str:
    """A query for the current rows of ``table``; ``key`` lists the identity's columns."""
    path = CLEAN_PATH.format("file_path")
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by {key} order by modified_at desc nulls last, seq desc) rn "
        f"from (select *, {path} as clean_path from {table})) where rn = 1"
    )


CURRENT_FUNCTIONS = current("code_functions", "repo, clean_path, class_name, name")
CURRENT_CLASSES = current("code_classes", "repo, clean_path, name")
