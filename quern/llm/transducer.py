"""Byte-pair encoding as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart
when encoded together. So the encoder is a transducer over bytes: a nondeterministic state
is a last token and a place in the trie of tokens; a determinised state is the set of those
still alive, each with the tokens since the last one that all share. Subsets and their transitions are
made when first met and kept. A token is emitted as soon as all live paths agree on it; the lookahead this
takes is bounded by the longest token, because each path's open part is one.

The text is parted into pretokens first, as the vocabulary's pattern demands; whole
pretokens seen before skip the transducer.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import regex

#: How the vocabulary's text is parted, in general and for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"

_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_GENERAL = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+")
_ASCII = re.compile(ASCII_PATTERN.replace(r"[^\s0-9A-Za-z]", r"[^\t\n\x0b\x0c\r 0-9A-Za-z]").replace(r"\s+(?!\S)", r"[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])").replace(r"|\s+", r"|[\t\n\x0b\x0c\r ]+"))

_STATES, _WORDS, _WORD_LENGTH, _PAIRS = 60_000, 300_000, 64, 400_000


def load_ranks(path: str | Path) -> dict[bytes, int]:
    """Tokens and their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary file in ``folder``, by default where the public tokenizers are installed."""
    return str(Path(folder or "/opt/tokenizers") / name)


class Transducer:
    """Encoder and decoder for one vocabulary; keeps states and words it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        # The trie of tokens: node -> byte -> node, and the token that ends at a node.
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                nxt = self.trie[node].get(byte)
                if nxt is None:
                    nxt = len(self.trie)
                    self.trie[node][byte] = nxt
                    self.trie.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A path: its last shared-or-open tokens and the trie node; the start has emitted nothing.
        self.states: list[tuple[tuple[tuple[int, ...], int], ...]] = [(((), 0),)]
        self.last: list[int] = [-1]
        self.number: dict = {(-1, self.states[0]): 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, data: bytes) -> list[int]:
        """The encoding of ``data`` by its definition: the lowest rank first, the leftmost of equals."""
        parts = [data[i: i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stay_apart(self, a: int, b: int) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            got = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.apart) > _PAIRS:
                self.apart.clear()
            self.apart[a, b] = got
        return got

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, trie, ends = self.last[state], self.trie, self.ends
        paths: list[tuple[tuple[int, ...], int]] = []
        for tokens, node in self.states[state]:
            nxt = trie[node].get(byte)
            if nxt is None:
                continue
            if trie[nxt]:
                paths.append((tokens, nxt))
            token = ends[nxt]
            if token >= 0:
                before = tokens[-1] if tokens else last
                if before < 0 or self.stay_apart(before, token):
                    paths.append(((*tokens, token), 0))
        # Tokens that all paths share are emitted.
        first, k = paths[0][0], 0
        while all(len(t) > k and t[k] == first[k] for t, _ in paths) if len(first) > k else False:
            k += 1
        out = first[:k]
        if k:
            paths = [(t[k:], n) for t, n in paths]
            last = out[-1]
        key = (last, tuple(sorted(paths)))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key[1])
            self.last.append(last)
            self.moves.append({})
        move = self.moves[state][byte] = (to, out)
        return move

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tokens of one pretoken, in time linear in its length."""
        if not data:
            return []
        if len(self.states) > _STATES:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in data:
            move = moves[state].get(byte) or self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        # One path only ends with a whole token: the encoding of all bytes so far.
        for tokens, node in self.states[state]:
            if node == 0:
                out += tokens
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; strings that look like special tokens are plain text; none for null and empty."""
        if not text:
            return []
        words = self.words
        found = _ASCII.findall(text) if text.isascii() else _GENERAL.findall(text)
        for w in set(found).difference(words):
            ids = self.encode_bytes(w.encode("utf-8", "replace"))
            if len(w) <= _WORD_LENGTH and len(words) < _WORDS:
                words[w] = ids
            else:
                return self._encode_rare(found)
        out: list[int] = []
        for ids in map(words.__getitem__, found):
            out += ids
        return out

    def _encode_rare(self, found: list[str]) -> list[int]:
        """As :meth:`encode`, for texts with pretokens too long or too many to keep."""
        if len(self.words) >= _WORDS:
            self.words.clear()
        words, out = self.words, []
        for w in found:
            ids = words.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode("utf-8", "replace"))
                if len(w) <= _WORD_LENGTH and len(words) < _WORDS:
                    words[w] = ids
            out += ids
        return out

    def decoder(self) -> "Decoder":
        return Decoder(self.tokens)


#: The least second byte, or the greatest, after these first bytes of UTF-8.
_LEAST = {0xE0: 0xA0, 0xF0: 0x90}
_MOST = {0xED: 0x9F, 0xF4: 0x8F}


class Decoder:
    """Streaming decoder: text comes out as soon as its bytes are whole; broken ones become U+FFFD."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.held = bytearray()
        self.need = 0

    def feed(self, ids: list[int]) -> str:
        done: list[str] = []
        for i in ids:
            for byte in self.tokens[i]:
                self._byte(byte, done)
        return "".join(done)

    def _byte(self, byte: int, done: list[str]) -> None:
        if self.need:
            least, most = 0x80, 0xBF
            if len(self.held) == 1:
                least, most = _LEAST.get(self.held[0], 0x80), _MOST.get(self.held[0], 0xBF)
            if least <= byte <= most:
                self.held.append(byte)
                self.need -= 1
                if not self.need:
                    done.append(self.held.decode("utf-8"))
                    self.held.clear()
                return
            done.append("�")
            self.held.clear()
            self.need = 0
        if byte < 0x80:
            done.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            self.held.append(byte)
            self.need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        else:
            done.append("�")

    def finish(self) -> str:
        out = "�" if self.need else ""
        self.held.clear()
        self.need = 0
        return out
