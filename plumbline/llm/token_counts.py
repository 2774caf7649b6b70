"""Exact token counts at every prefix of every text (operator 1).

A byte-pair encoding has a property that makes a dynamic program exact: a
sequence of tokens is the encoding of its bytes if and only if every adjacent
pair of tokens is the encoding of *its* bytes. So the encoding of a prefix ends
in the one vocabulary token ``t`` that is compatible with the last token of the
prefix before ``t``, and ``count[i] = count[i - len(t)] + 1``. One left-to-right
pass over a pre-token yields the count of each of its prefixes.

Pre-tokens of the byte-level pattern only depend on what follows them in runs
of white space, so a *unit* - a pre-token, or a white-space run together with
the pre-token after it - can be counted alone. Units repeat, so each worker
keeps the counts of recent units, and a text's prefix table is a concatenation
of small byte strings: signed steps of the count, one for each character.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: White-space runs of two or more join the pre-token after them.
UNIT = rf"\s+(?=\s\S)(?: (?:{_RUN})|\s(?:'s|'t|'re|'ve|'m|'ll|'d|{_RUN}))|{PATTERN}"
#: Units kept per worker; the memory of a worker stays bounded.
UNITS_KEPT = 1_500_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for a byte-level BPE vocabulary (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        symbols = _byte_symbols()
        decode = lambda s: bytes(symbols[c] for c in s)
        self.vocabulary = {decode(t) for t in model["vocab"]}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[decode(a), decode(b)] = i
        self.longest = max(map(len, self.vocabulary))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pattern, self._units = regex.compile(PATTERN), regex.compile(UNIT)
        self._space, self._lead = regex.compile(r"\s+").fullmatch, regex.compile(r"\s*")
        self._compatible: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._steps: dict[str, bytes] = {}
        # the same merges for the library that is fastest on whole texts
        self._bytes_of = np.array([1] * 256 + [len(a + b) for a, b in self.ranks], np.int64)
        order = [*(bytes([b]) for b in range(256)), *(a + b for a, b in self.ranks)]
        self._whole_texts = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})

    def _merge(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.ranks:
                break
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def _fits(self, a: bytes, b: bytes) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self._merge(a + b) == [a, b]
        return known

    def _reachable(self, token: bytes) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self._merge(token) == [token]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of one pre-token."""
        count, last = [0], [b""]
        vocabulary, longest = self.vocabulary, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in vocabulary and (self._fits(last[start], token) if start else self._reachable(token)):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("vocabulary lacks single bytes")
        return count

    def _text_counts(self, text: str) -> list[int]:
        """Counts at every character prefix of a short text, prefix by prefix
        where pre-tokens change with what follows."""
        out = []
        for end in range(1, len(text) + 1):
            out.append(sum(self.piece_counts(p.encode())[-1] for p in self._pattern.findall(text[:end])))
        return out

    def unit_steps(self, unit: str) -> bytes:
        known = self._steps.get(unit)
        if known is not None:
            return known
        first = unit[0]
        if first != "'" and not (len(unit) > 1 and self._space(unit[:2]) and not self._space(unit)):
            counts = self._piece_chars(unit)  # one pre-token, and so is every prefix of it
        else:
            head = len(self._lead.match(unit)[0])
            if head < 2:
                counts = self._text_counts(unit)
            else:  # a white-space run, then the pre-token after it
                counts = self._piece_chars(unit[:head])
                lead = head - 1
                before = counts[lead - 1]
                tail = unit[lead:]
                if tail[0] == " ":
                    counts += [before + c for c in self._piece_chars(tail)[1:]]
                else:
                    before += self.piece_counts(tail[0].encode())[-1]
                    counts += [before + c for c in self._text_counts(tail[1:])] if tail[1] == "'" else [before + c for c in self._piece_chars(tail[1:])]
        known = struct.pack(f"{len(counts)}b", *map(int.__sub__, counts, [0, *counts]))  # raises beyond a signed byte
        if len(self._steps) >= UNITS_KEPT:
            self._steps.clear()
        if len(unit) <= 64:
            self._steps[unit] = known
        return known

    def _piece_chars(self, piece: str) -> list[int]:
        by_byte = self.piece_counts(piece.encode())
        if piece.isascii():
            return by_byte[1:]
        return [by_byte[e] for e in itertools.accumulate(len(c.encode()) for c in piece)]

    def steps(self, text: str) -> bytes:
        """Signed byte per character: by how much the count of the prefix that
        ends there differs from that of the prefix one character shorter."""
        if self._split is None or not any(s in text for s in self.special):
            known = self._steps.get
            make = self.unit_steps
            return b"".join([known(u) or make(u) for u in self._units.findall(text)])
        out, total = [], 0
        for i, part in enumerate(self._split.split(text)):
            if i % 2 == 0:
                out.append(self.steps(part))
                total += int(np.frombuffer(out[-1], np.int8).sum(dtype=np.int64))
                tail = part
            else:  # a special string: its proper prefixes are ordinary text after the part before
                units = self._units.findall(tail)
                last = units[-1] if units else ""
                base = total - (self.count(last) if last else 0)
                marks = [total]
                for end in range(1, len(part)):
                    marks.append(base + self.count(last + part[:end]))
                total += 1
                out.append(np.diff(np.array([*marks, total])).astype(np.int8).tobytes())
        return b"".join(out)

    def token_bytes(self, text: str) -> np.ndarray:
        """Bytes of each token of the whole text, without its prefix table."""
        if self._split is not None and any(s in text for s in self.special):
            parts = enumerate(self._split.split(text))
            return np.concatenate([[len(part.encode())] if i % 2 else self.token_bytes(part) for i, part in parts]).astype(np.int64)
        return self._bytes_of[self._whole_texts.encode_ordinary(text)]

    def count(self, text: str) -> int:
        return int(np.frombuffer(self.steps(text), np.int8).sum(dtype=np.int64))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """For every row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``cut_chars`` and
    ``steps``.

    ``steps`` is the prefix table: a signed byte for each character, whose
    running sum is the exact token count of that prefix (see prefix_counts()).
    ``cut_chars`` answers truncation from it: the most characters whose prefix
    has at most ``limit`` tokens. Null counts as the empty text: zero tokens.
    Repeated rows give repeated results; other columns are ignored. Each text
    is handled alone, so nothing is shuffled and a lost task is just rerun.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens, cuts, tables = [], [], [], []
            for scalar in texts:
                text = scalar.as_py() or ""
                steps = own.steps(text)
                counts = np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)
                n_bytes.append(len(text.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                within = np.flatnonzero(counts <= limit) if n_tokens[-1] > limit else ()
                cuts.append(len(text) if n_tokens[-1] <= limit else int(within[-1]) + 1 if len(within) else 0)
                tables.append(steps)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(cuts, pa.int64()), pa.array(tables, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "cut_chars", "steps"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, cut_chars long, steps binary"
    )


def count_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ends`` for every row: the counts of
    prefix_table() where no prefix is asked for. ``ends`` are the bytes at which
    pieces of ``max_len`` tokens end, the last at the end of the text; one piece
    without ``max_len``. Null counts as the empty text: no tokens, one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            totals, ends = [], []
            for t in batch.column(1):
                sizes = own.token_bytes(t.as_py() or "")
                upto = np.cumsum(sizes)
                totals.append(len(sizes))
                ends.append(np.append(upto[max_len - 1 : -1 : max_len] if max_len else upto[:0], upto[-1] if len(upto) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "ends"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ends array<long>")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def prefix_counts(steps: bytes) -> np.ndarray:
    """Token count of every character prefix, from a row's ``steps``."""
    return np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)
