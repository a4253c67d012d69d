"""Encoding of a corpus with a public byte-level BPE tokenizer; long texts by tree concatenation."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import ship

#: Folder of the public tokenizers, and the vocabulary used by default.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which these vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are cut into parts of about PART, encoded as rows of their own.
LONG = 8192
PART = 4096
#: Bytes of an unsplit piece up to which it is merged in one go.
LEAF = 256


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _splitter():
    import regex

    return regex.compile(PATTERN)


class Piecewise:
    """Exact encoding of unsplit pieces by halves.

    Two encodings are joined by re-encoding a window around the join, doubled until both of its ends agree: a sequence
    of tokens is the encoding of its bytes exactly if each pair of neighbouring tokens is the encoding of the pair's
    bytes, so agreement of the window's outer pairs makes the whole exact.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        self.enc, self.leaf = encoder(path), leaf
        self.single = self.enc._encode_single_piece
        self.bytes_of = self.enc.decode_single_token_bytes

    def _agree(self, a: int, b: int) -> bool:
        return self.single(self.bytes_of(a) + self.bytes_of(b)) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        w = 1
        while True:
            a, b = left[max(0, len(left) - w) :], right[:w]
            rest_l, rest_r = left[: len(left) - len(a)], right[len(b) :]
            middle = self.single(b"".join(map(self.bytes_of, a + b)))
            if (not rest_l or self._agree(rest_l[-1], middle[0])) and (not rest_r or self._agree(middle[-1], rest_r[0])):
                return rest_l + middle + rest_r
            w *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.single(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def node(self, text: str) -> tuple[str, list[int], list[list[int]]]:
        """Text, character lengths of its pieces, ids of each piece."""
        pieces = _splitter().findall(text)
        return text, [len(p) for p in pieces], [self.piece(p.encode()) for p in pieces]

    def concat(self, left, right, glued: bool):
        """Node of the two nodes' texts. Without `glued` the border is known to separate pieces.

        Otherwise only the left's last piece can change, or the last two where a lone letter follows an apostrophe:
        splitting starts again there and goes on until a piece ends where one of the right's pieces does.
        """
        (lt, ll, li), (rt, rl, ri) = left, right
        if not glued or not ll or not rl:
            return lt + rt, ll + rl, li + ri
        again = 2 if ll[-1] == 1 and len(ll) > 1 else 1
        cut = sum(ll[-again:])
        text = lt[len(lt) - cut :] + rt
        end, at, j, lens, ids = cut + rl[0], 0, 0, [], []
        for m in _splitter().finditer(text):
            at = m.end()
            lens.append(at - m.start())
            whole = m.start() == cut - ll[-1] and at == cut + rl[0]
            ids.append(self.join(li[-1], ri[0]) if whole else self.piece(m.group().encode()))
            while end < at and j + 1 < len(rl):
                j += 1
                end += rl[j]
            if end == at:
                break
        return lt + rt, ll[:-again] + lens + rl[j + 1 :], li[:-again] + ids + ri[j + 1 :]

    def tree(self, nodes, glued):
        """Join nodes by halves; glued[i] tells whether node i continues node i - 1 within a piece."""
        if len(nodes) == 1:
            return nodes[0]
        half = len(nodes) // 2
        return self.concat(self.tree(nodes[:half], glued[:half]), self.tree(nodes[half:], glued[half:]), glued[half])


def cut_text(text: str, part: int = PART) -> list[tuple[str, bool]]:
    """Parts of a text, each with whether it continues the part before it within an unsplit stretch.

    Wherever a space follows a character that isn't white space, a piece ends; parts end there if such a place lies
    within half a part of the wanted length, else anywhere.
    """
    out, start, glued = [], 0, False
    while start < len(text):
        want = start + part
        if want >= len(text):
            out.append((text[start:], glued))
            break
        cut = 0
        for i in range(min(want + part // 2, len(text) - 1), start + part // 2, -1):
            if text[i] == " " and not text[i - 1].isspace():
                cut = i
                break
        out.append((text[start : cut or want], glued))
        start, glued = cut or want, not cut
    return out


def _list_array(ids: list) -> pa.Array:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if len(ids) else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _encode_short(path: str, carry: list[str], rows: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = _list_array([enc.encode_ordinary(t) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column("key"), *(b.column(c) for c in carry), ids], names=["key", *carry, "ids"])

    return run


def _cut(part: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, digest, text, *more in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "text", *carry)), strict=True):
                parts = cut_text(text, part)
                n = len(parts)
                glued = [g for _, g in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n, pa.int64()),
                        pa.array([digest] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(glued, pa.bool_()),
                        pa.array([g or h for g, h in zip(glued, [*glued[1:], False], strict=True)], pa.bool_()),
                        pa.array([t for t, _ in parts], pa.string()),
                        *(pa.array([x] * n, pa.string()) for x in more),
                    ],
                    names=["key", "digest", "no", "glued", "detail", "text", *carry],
                )

    return run


def _encode_parts(path: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, by_piece = encoder(path), Piecewise(path)
        for b in batches:
            lens, counts, ids, texts = [], [], [], []
            for text, detail in zip(b.column("text").to_pylist(), b.column("detail").to_pylist(), strict=True):
                if detail:
                    _, n, pieces = by_piece.node(text)
                    lens.append(n)
                    counts.append([len(p) for p in pieces])
                    ids.append([x for p in pieces for x in p])
                    texts.append(text)
                else:
                    lens.append([])
                    counts.append([])
                    ids.append(enc.encode_ordinary(text))
                    texts.append("")
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("key", "digest", "no", "glued", "detail", *carry)), pa.array(texts, pa.string()), _list_array(lens), _list_array(counts), _list_array(ids)],
                names=["key", "digest", "no", "glued", "detail", *carry, "text", "lens", "counts", "ids"],
            )

    return run


def _join_parts(path: str, carry: list[str]):
    def run(t: pa.Table) -> pa.Table:
        by_piece = Piecewise(path)
        rows = sorted(t.to_pylist(), key=lambda r: r["no"])
        ids: list[int] = []
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j]["glued"]:
                j += 1
            if rows[i]["detail"]:
                nodes = []
                for r in rows[i:j]:
                    at = np.concatenate([[0], np.cumsum(r["counts"])]).astype(int).tolist()
                    nodes.append((r["text"], r["lens"], [r["ids"][a:z] for a, z in zip(at[:-1], at[1:], strict=True)]))
                _, _, pieces = by_piece.tree(nodes, [r["glued"] for r in rows[i:j]])
                for p in pieces:
                    ids += p
            else:
                ids += rows[i]["ids"]
            i = j
        more = {c: pa.array([rows[0][c]], pa.string()) for c in carry}
        return pa.table({"key": pa.array([rows[0]["key"]], pa.int64()), **more, "ids": _list_array([ids])})

    return run


def encode_corpus(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folder: str = FOLDER,
    vocabulary: str = VOCABULARY,
    long: int = LONG,
    part: int = PART,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Token ids of every text: key, the string columns of `carry`, ids (array of int).

    Special tokens are never added; their strings are plain text. Null and empty texts get an empty list. Each row
    comes out, repeated keys and copies too. Other columns are ignored. Texts up to `long` characters are encoded where
    they are read, without a shuffle. Longer ones are cut into parts that become rows of their own and are encoded in
    parallel; parts of an unsplit stretch are joined by halves, see `Piecewise`, with the same ids as the whole text
    has. Only the parts of one text ever meet in one task.
    """
    ship(documents.sparkSession)
    path, carry = f"{folder}/{vocabulary}", list(carry)
    kept = [f"c{i}" for i in range(len(carry))]
    carried = [*kept, "_copies"]
    more = "".join(f", {c} string" for c in kept)
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)])
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = rows.where(size <= long).mapInArrow(_encode_short(path, kept), f"key long{more}, ids array<int>")
    parts = (
        rows.where(size > long)
        .groupBy("key", "text", *kept)  # copies are counted before the shuffle, and encoded once
        .agg(F.count(F.lit(1)).cast("string").alias("_copies"))
        .withColumn("digest", F.xxhash64("text"))
        .mapInArrow(_cut(part, carried), f"key long, digest long, no int, glued boolean, detail boolean, text string{more}, _copies string")
        .repartition("key", "digest", "no")
        .mapInArrow(
            _encode_parts(path, carried),
            f"key long, digest long, no int, glued boolean, detail boolean{more}, _copies string, text string, lens array<int>, counts array<int>, ids array<int>",
        )
    )
    joined = parts.groupBy("key", "digest", *carried).applyInArrow(_join_parts(path, carried), f"key long{more}, _copies string, ids array<int>")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")
    return short.unionByName(joined).select(F.col("key").alias(key), *[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "ids")
