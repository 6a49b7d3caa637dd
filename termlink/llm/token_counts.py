"""Token counts without token ids.

Byte-level BPE never joins pieces across pre-tokens, so a text's count is the sum
over its pre-tokens.  Three steps:

1. count pre-tokens over the corpus (pre-aggregated in each task) and count the
   pieces of each distinct one, once, with the library's own merge model;
2. join the dictionary to the pre-token frequencies of each document: its
   ``head`` most frequent entries, a table of proven size (at most ``head`` entries
   of ``head_bytes`` bytes), by broadcast; all other entries by an
   ordinary equi-join on the pre-token;
3. sum per document.

The special strings of the vocabulary file are found first and count as one
token each, as the library does by default.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a null doc_id is
returned as null; repeated rows are returned as often as they occur; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm.tables import small_text_batches, staged

#: Entries of a task's counter before it is emitted and emptied.
_HELD = 100_000
#: Characters on which the fast splitter and the library's agree in every
#: Unicode version; a text with others is split by the library.
_PLAIN = re.compile("[^\x00-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


class Splitter:
    """Pre-tokens of a text and the number of pieces of a pre-token, for a
    ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if (spec["model"]["type"], pre.get("type")) != ("BPE", "ByteLevel") or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is asked for")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens that take their surroundings aren't supported")
        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).findall
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        # the alphabet of byte-level vocabularies: visible bytes stand for themselves,
        # the others for the characters from 256 on
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(256, 512))
        self.alphabet = {b: b if b in visible else next(hidden) for b in range(256)}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings between them."""
        pieces = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for p in pieces:
            if _PLAIN.search(p):
                out += [p[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)]
            else:
                out += self.find(p)
        return out, len(pieces) - 1

    def pieces(self, token: str) -> int:
        return len(self.library.model.tokenize(token.encode().decode("latin-1").translate(self.alphabet)))


@lru_cache(maxsize=2)
def splitter(path: str, pattern: str) -> Splitter:
    return Splitter(path, pattern)


def dictionary(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``token, total, pieces`` of every distinct pre-token of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = splitter(path, pattern), Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["token", "n"])
            held.clear()
            return out

        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    held.update(s.split(text.as_py())[0])
                    if len(held) >= _HELD:
                        yield emit()
        yield emit()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path, pattern)
        for b in batches:
            n = [s.pieces(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["token", "total", "pieces"])

    totals = (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token string, n long")
              .groupBy("token").agg(F.sum("n").alias("total")))
    return totals.mapInArrow(pieces, "token string, total long, pieces long")


def _head(known: DataFrame, head: int) -> dict[str, int]:
    """Pieces of the most frequent tokens, ``head`` at most: all of at least the
    least frequency class (quarters of a power of two) that keeps to the bound."""
    level = F.floor(4 * F.log2("total"))
    classes = known.groupBy(level.alias("level")).count().collect()    # 4 * 63 rows at most
    least, n = None, 0
    for c in sorted(classes, reverse=True):
        n += c["count"]
        if n > head:
            break
        least = c["level"]
    if least is None:
        return {}
    top = known.where(level >= least).select("token", "pieces").toArrow()
    return dict(zip(top["token"].to_pylist(), top["pieces"].to_pylist()))


def token_counts(docs: DataFrame, path: str, pattern: str, head: int = 1 << 18, head_bytes: int = 64,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``."""
    spark = docs.sparkSession
    small_text_batches(spark)
    known = staged(dictionary(docs, path, pattern, text_col), "pretokens")
    common = spark.sparkContext.broadcast(_head(known.where(F.octet_length("token") <= head_bytes), head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path, pattern)
        sizes: Callable[[str], int | None] = common.value.get
        for b in batches:
            n_bytes, sums, ends = [], [], [0]
            rare: list[str] = []
            times: list[int] = []
            for text in b.column(1):
                text = text.as_py() or ""
                tokens, total = s.split(text)
                for t, n in Counter(tokens).items():
                    k = sizes(t)
                    if k is None:
                        rare.append(t)
                        times.append(n)
                    else:
                        total += n * k
                n_bytes.append(len(text.encode()))
                sums.append(total)
                ends.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["k", "n_bytes", "n_tokens", "rare"])

    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id")).alias("k"),
                        F.col(text_col).alias("text"))
    kind = keyed.schema["k"].dataType.simpleString()
    part = staged(keyed.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, rare array<struct<token:string,n:long>>")
                  .select("k.*", "n_bytes", "n_tokens", "rare"), "token-sums")
    rest = (part.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n")
            .join(known.select("token", "pieces"), "token")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more")))
    return (part.select("row", "doc_id", "n_bytes", "n_tokens").join(rest, "row", "left")
            .select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens")))

