"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

1. Texts are cut into pre-tokens (words). Each task gathers its texts into bundles of
   bounded size; a bundle keeps its distinct words once, the most frequent first and
   those of similar frequency in order, and each text as its words' places. The bundles are written to the
   shared folder, bucketed by bundle.
2. The bundles' words are shuffled by word, so that all bundles' requests for a word
   meet in one sorted partition, which encodes each distinct word once.
3. The words' ids go back to the bundles that asked, and each text is put together by
   position. As the bundles are bucketed, only the ids are shuffled.

Decoding looks ids up in the table of the vocabulary's byte strings, which has a fixed
size and is broadcast.

Defined results: a null or empty text has no ids; a text is never cut, so one that is
longer than a bundle makes a bundle of its own; rows that repeat get a result each; an
empty table gives an empty result; extra columns are ignored. Special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import new_path, release_memory
from eventloom.session import ship_package

#: Code points of a bundle; its last text may go beyond.
BUNDLE_CHARS = 1 << 24


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base-64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the neighbours of lowest rank are joined first, the leftmost among equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not i < middle < stop or end[middle] != stop:  # one of the two has changed
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (p := before[i]) >= 0 and (rank := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (rank, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def _planes(numbers) -> bytes:
    """Numbers as their bytes by significance: the upper ones are mostly zero and compress well."""
    return np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class Bundle:
    """Texts as positions in a list of distinct words."""

    def __init__(self, pattern: regex.Pattern):
        self.words: dict[str, int] = {}
        self.find, self.pieces = pattern.findall, {}
        self.ids, self.codes, self.chars = [], [], 0

    def _cut(self, text: str) -> list[int]:
        words = self.words
        return [words.setdefault(w, len(words)) for w in self.find(text)]

    def _by_piece(self, text: str) -> list[int] | None:
        """Cut at single spaces between other characters, where pre-tokens always end.

        Each distinct piece is cut once. None if white space stands elsewhere at a cut.
        """
        body = text.rstrip(" \t\r\n")
        first, *rest = body.split(" ")
        if not first or first[-1].isspace():
            return None
        out, pieces, words = self._cut(first), self.pieces, self.words
        for piece in rest:
            own = pieces.get(piece)
            if own is None:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    return None
                own = pieces[piece] = [words.setdefault(" " + piece, len(words))] if piece.isalpha() else self._cut(" " + piece)
            out.extend(own)
        if len(body) < len(text):
            out.extend(self._cut(text[len(body) :]))
        return out

    def add(self, doc_id, text: str) -> None:
        codes = self._by_piece(text)
        self.ids.append(doc_id)
        self.codes.append(np.array(self._cut(text) if codes is None else codes, np.uint32))
        self.chars += len(text)

    def row(self) -> dict:
        lengths = np.array([len(c) for c in self.codes], np.int32)
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.words))
        words = list(self.words)
        # A piece that was met in a text cut otherwise later may have added words nobody uses.
        used = sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-int(counts[i]).bit_length(), words[i]))
        place = np.zeros(len(words), np.uint32)
        place[used] = np.arange(len(used))
        return {
            "words": [words[i] for i in used],
            "doc_ids": self.ids,
            "lengths": lengths,
            "codes": zstandard.compress(_planes(place[codes])),
        }


def _bundles(pattern: str, bundle_chars: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, number = regex.compile(pattern), 0
        bundle = Bundle(compiled)
        name = lambda: (TaskContext.get().partitionId() << 32) + number
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text):
                bundle.add(None if pd.isna(doc_id) else doc_id, text)
                if bundle.chars >= bundle_chars:
                    yield pd.DataFrame([bundle.row() | {"bundle": name()}])
                    bundle, number = Bundle(compiled), number + 1
        if bundle.ids:
            yield pd.DataFrame([bundle.row() | {"bundle": name()}])
        del bundle
        release_memory()

    return make


def _encode_words(ranks):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids = None, []
        for batch in batches:
            known, number = [], []
            for word, same in groupby(batch.word):
                if word != last:
                    last, ids = word, merge(word.encode("utf-8", "surrogatepass"), ranks.value)
                number += [len(known)] * sum(1 for _ in same)
                known.append(ids)
            # One row for each bundle in the batch, so that the way back carries no row per word.
            own, codes = np.array(number), batch.code.to_numpy()
            order = np.argsort(batch.bundle.to_numpy(), kind="stable")
            names, starts = np.unique(batch.bundle.to_numpy()[order], return_index=True)
            out = []
            for part in np.split(order, starts[1:]):
                some = [known[i] for i in own[part]]
                out.append((_planes(codes[part]), _planes([len(x) for x in some]), _planes([i for x in some for i in x])))
            yield pd.DataFrame(out, columns=["codes", "sizes", "ids"]).assign(bundle=names)
        release_memory()

    return encode


def _assemble(bundles: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    joined = lambda parts: np.concatenate([np.zeros(0, np.uint32), *map(_from_planes, parts)])
    by_word, flat = joined(words.sizes).astype(np.int64), joined(words.ids).astype(np.int32)
    codes = joined(words.codes)
    sizes, starts = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    sizes[codes], starts[codes] = by_word, np.cumsum(by_word) - by_word
    doc_ids, ids = [], []
    for row in bundles.itertuples():
        codes, at = _from_planes(zstandard.decompress(row.codes)), 0
        for doc_id, length in zip(row.doc_ids, row.lengths):
            own = codes[at : at + length]
            at += length
            n = sizes[own]
            ends = np.cumsum(n)
            steps = np.arange(ends[-1] if length else 0) + np.repeat(starts[own] - (ends - n), n)
            doc_ids.append(doc_id)
            ids.append(flat[steps])
    return pd.DataFrame({"doc_id": pd.Series(doc_ids, dtype=object), "ids": ids})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", bundle_chars: int = BUNDLE_CHARS, finish=None) -> DataFrame:
    """Per row: doc_id and its token ids.

    `finish`, a function and the schema of what it adds to doc_id, takes the place of the
    ids: it is applied to the rows (doc_id, ids) of each bundle where they are put together.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"words array<string>, doc_ids array<{id_type}>, lengths array<int>, codes binary, bundle long"
    path = new_path(spark, "bundles")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.mapInPandas(_bundles(pattern, bundle_chars), schema)
        .write.option("path", path).option("compression", "zstd").bucketBy(buckets, "bundle").saveAsTable(name)
    )
    bundles = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and `bundles` still knows how they are bucketed
    words = (
        bundles.select("bundle", F.posexplode("words").alias("code", "word"))
        .repartition("word").sortWithinPartitions("word")
        .mapInPandas(_encode_words(spark.sparkContext.broadcast(ranks)), "codes binary, sizes binary, ids binary, bundle long")
    )
    kept = bundles.select("bundle", "doc_ids", "lengths", "codes")
    last, added = finish or (lambda rows: rows, "ids array<int>")
    return kept.groupBy("bundle").cogroup(words.groupBy("bundle")).applyInPandas(
        lambda b, w: last(_assemble(b, w)), f"doc_id {id_type}, {added}"
    )


def _token_bytes(encoded: DataFrame, ranks: dict[bytes, int]):
    """The byte string of each id, broadcast: its size is the vocabulary's."""
    ship_package(encoded.sparkSession)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return encoded.sparkSession.sparkContext.broadcast(table)


def _look_up(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add `content`, the bytes that the ids stand for."""
    table = _token_bytes(encoded, ranks)

    def contents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_look_up(ids, table.value) for ids in batch])

    return encoded.withColumn("content", F.pandas_udf(contents, "binary")("ids"))


def encode_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, **how) -> DataFrame:
    """Per row: doc_id, the number of ids, and hashes of the ids and of the content they decode to.

    Ids are decoded and hashed in the task that puts them together, and go no further.
    """
    table = _token_bytes(docs, ranks)
    of = lambda data: hashlib.sha256(data).hexdigest()

    def hashes(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "doc_id": rows.doc_id,
                "n_tokens": [len(ids) for ids in rows.ids],
                "ids_sha256": [of(np.asarray(ids, "<u4").tobytes()) for ids in rows.ids],
                "decoded_sha256": [of(_look_up(ids, table.value)) for ids in rows.ids],
            }
        )

    return encode(docs, ranks, pattern, finish=(hashes, "n_tokens long, ids_sha256 string, decoded_sha256 string"), **how)
