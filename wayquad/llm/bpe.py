"""Byte-level BPE encoding with a pair occurrence index, and decoding.

A partition is encoded in blocks of whole texts of about ``BLOCK_BYTES``.  Texts are cut into pre-tokens; each
distinct pre-token that a worker does not know yet lies once in one symbol array.  The index maps the rank of
every adjacent pair to all positions where it occurs; ranks leave a heap in ascending order, all occurrences of a
pair merge at once, and only the lists of the pairs beside the merged positions are touched.

Tokenizer files whose settings this module does not follow (normalizers, other pre-tokenizers, prefix spaces,
added tokens that take in white space, dropout, unknown tokens, affixes, byte fallback) are refused with ValueError.

Defined results: null and empty texts have no ids; an added token written out in a text is that token;
texts of any length are encoded whole; other columns stay as they are; repeated rows are encoded each.  The
memory of pre-tokens is emptied when it holds ``MEMO_WORDS`` entries, which changes no result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayquad.llm.common import ready, slices, table, texts

MEMO_WORDS = 150_000
#: Bytes of text whose new pre-tokens are encoded together.
BLOCK_BYTES = 4 << 20
#: The published byte-level pre-tokenizer pattern (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
#: Settings of a tokenizer file that change ids, with the values that this module follows (fixed values).
SETTINGS = {
    "model": {"type": ("BPE",), "dropout": (None, 0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)},
    "pre_tokenizer": {"type": ("ByteLevel",), "add_prefix_space": (False,), "use_regex": (None, True)},
    "decoder": {"type": ("ByteLevel",)},
}


def _plane() -> re.Pattern:
    """``PRE_TOKENS`` for texts without characters beyond U+FFFF, with its classes written as ranges.

    The standard module takes well under half the time of ``regex`` for it, but looks through ranges beyond U+FFFF one by one.
    """
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        found: list[list[int]] = []
        for c in map(ord, regex.findall(kind, every)):
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)

    letters, numbers, spaces = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    text = PRE_TOKENS.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return re.compile(text.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def check(spec: dict) -> None:
    """Refuse a tokenizer file with settings that would change ids."""
    wrong = [f"{part}.{name}" for part, names in SETTINGS.items() for name, allowed in names.items() if (spec.get(part) or {}).get(name) not in allowed]
    wrong += ["normalizer"] if spec.get("normalizer") is not None else []
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if wrong:
        raise ValueError(f"a tokenizer file with settings that are not followed: {', '.join(wrong)}")


class Cutter:
    """Whole texts by way of their distinct pre-tokens; ``words`` of a subclass encodes these, ``limit`` bounds the memory."""

    limit = MEMO_WORDS

    def __init__(self, spec: dict):
        check(spec)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre, self.plane, self.beyond = regex.compile(PRE_TOKENS), _plane(), re.compile("[\U00010000-\U0010ffff]")
        self.known: dict[str, bytes] = {}

    def words(self, distinct: list[str]) -> list[bytes]:
        raise NotImplementedError

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.pre if self.beyond.search(text) else self.plane).findall(text)

    def segments(self, parts: list[str]) -> list[bytes]:
        """The ids of texts that hold no added token, as the bytes of int32 values."""
        cut = list(map(self.cut, parts))
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, self.words(new), strict=True))
        return [b"".join(map(known.__getitem__, ws)) for ws in cut]

    def encode(self, block: list[str]) -> list[bytes]:
        """The ids of any texts."""
        if self.splitter is None or not any(a in t for a in self.added for t in block):
            return self.segments(block)
        cut = [self.splitter.split(t) for t in block]
        plain = iter(self.segments([x for c in cut for x in c[::2]]))
        return [b"".join([next(plain) if k % 2 == 0 else np.array([self.added[x]], "<i4").tobytes() for k, x in enumerate(c)]) for c in cut]


class PairIndexBpe(Cutter):
    """The merges and the vocabulary of a tokenizer file, applied by a pair occurrence index."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        super().__init__(spec)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.byte_ids = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left * self.size + self.right
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys = keys[self.rank_of]
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()

    def words(self, distinct: list[str]) -> list[bytes]:
        """The ids of each word, as the bytes of int32 values."""
        if not distinct:
            return []
        raw = [w.encode() for w in distinct]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(symbols)
        symbols = np.append(symbols, 0)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - sizes] = n, n
        after[n] = before[n] = n

        def ranks(at: np.ndarray) -> np.ndarray:
            then = after[at]
            key = symbols[at] * self.size + symbols[then]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where((self.keys[i] == key) & (then < n), self.rank_of[i], NO_RANK)

        rank = np.append(ranks(np.arange(n)), NO_RANK)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, found: np.ndarray) -> None:
            """Put positions into the lists of their pairs."""
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            start = 0
            for stop in (*cuts.tolist(), len(at)):
                r = int(found[start])
                if r in index:
                    index[r].append(at[start:stop])
                else:
                    index[r] = [at[start:stop]]
                    heapq.heappush(active, r)
                start = stop

        here = np.flatnonzero(rank[:n] < NO_RANK)
        if len(here):
            note(here, rank[here])
        gone = np.zeros(n + 1, dtype=bool)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(lists) > 1 or self.left[r] == self.right[r]:
                at = np.unique(at)
            if self.left[r] == self.right[r]:  # in a run of one symbol the leftmost pairs win
                taken, used = [], -1
                for p in at.tolist():
                    if p != used:
                        taken.append(p)
                        used = int(after[p])
                at = np.array(taken, dtype=np.int64)
            second = after[at]
            third = after[second]
            symbols[at] = self.merged[r]
            gone[second] = True
            rank[second] = NO_RANK
            after[at] = third
            before[third] = at
            ahead = before[at]
            touched = np.concatenate((at, ahead[ahead < n]))
            found = ranks(touched)
            rank[touched] = found
            live = found < NO_RANK
            if live.any():
                note(touched[live], found[live])
        kept = ~gone[:n]
        ids = symbols[:n][kept].astype("<i4").tobytes()
        stops = np.cumsum(np.add.reduceat(kept, ends - sizes)) * 4
        return [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def _strings(bpe: PairIndexBpe, ids: list[bytes]) -> pa.Array:
    return pa.array([bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string())


def encode(rows: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``into``, the array of token ids of ``text``, and the text decoded from them where ``decoded`` names a column.

    Columns of these names are replaced.
    """
    ready(rows.sparkSession)
    new = [into] if decoded is None else [into, decoded]
    rows = rows.drop(*new)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in slices(batches, text, BLOCK_BYTES):
            ids = bpe.encode(texts(batch.column(batch.schema.get_field_index(text))))
            offsets = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))]
            if decoded is not None:
                columns.append(_strings(bpe, ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    kinds = [T.StructField(into, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *kinds[: len(new)]]))


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the text of the token ids; null ids give the empty text; a column of that name is replaced."""
    ready(rows.sparkSession)
    rows = rows.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            found = [x.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes() if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(bpe, found)], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def digests(rows: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from ids and decoded."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    return digests(encode(docs, path, decoded="decoded"))
