"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokenizer A (a byte-level BPE file of ``tokenizers``) encodes a space and the text, tokenizer B
(a ``sentencepiece`` model that adds that space itself) encodes the text.  Both token lists are
lists of ascending byte ends, which are intersected by galloping: the shorter list drives, and each of its
ends is looked up in the longer one in steps of doubling length from the last place, then by
bisection.  Ends found in both cut the tokens into groups; the places of two successive ends
(their rank difference) are the range of tokens that one token overlaps.  Overlapping tokens are *links*.

* *Chunks.*  No token of either kind reaches over a single space between two visible
  characters: A's splitting pattern begins a word there, and no piece of B has the space mark behind
  another character (checked when the model is loaded).  So a text is aligned chunk by chunk, and a chunk's
  alignment is remembered by the worker, about ``_HELD`` of them at most.  All new chunks of about ``_PART`` characters
  of texts are aligned together, one behind the other, and their ends gallop in step.
* *Counts.*  Each task sums the links of each id pair; Spark adds them up.  No text or chunk is shuffled.
* *Documents.*  A document's figures are sums over its chunks.  The counts of the ``head``
  most frequent pairs (a table of proven size) are broadcast; a document's other
  pairs, each once with its number, are joined with their counts.

Edge cases: texts that are null, empty, or aren't restored byte by byte by both token lists (B takes
U+2581 for a space) have no tokens, zeros everywhere, and count in no pair; special strings in texts are
plain text; a null doc_id is carried; repeated rows are rows of their own; very long
texts are taken in parts that end between chunks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm.tables import small_text_batches, staged
from termlink.llm.token_counts import _PLAIN, Splitter

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of texts that are split at once, and alignments that a worker remembers.
_PART, _HELD = 1 << 19, 600_000
_SHIFT = 32
_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def gallop(ends: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` the least place, from its place in ``at`` on, of an end that isn't below it: by steps
    of doubling length, then by bisection of the last one.  The last end is below none."""
    low, high = at.copy(), at.copy()
    todo, step = np.flatnonzero(ends[high] < wanted), 1
    while len(todo):
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, len(ends) - 1)
        todo, step = todo[ends[high[todo]] < wanted[todo]], 2 * step
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        below = ends[middle] < wanted[todo]
        low[todo[below]] = middle[below] + 1
        high[todo[~below]] = middle[~below]
        todo = todo[low[todo] < high[todo]]
    return low


def intersect(short: np.ndarray, long: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(common, first, last)`` of two ascending lists of ends, the last of which are equal: whether an end of the shorter
    list is one of the longer, too, and the first and last token of the longer list that its token overlaps.
    ``at``: places from which the longer list is searched."""
    last = gallop(long, short, at)
    common = long[last] == short
    first = np.zeros_like(last)
    # behind a common end begins the next token, else the one that holds the end goes on
    first[1:] = last[:-1] + common[:-1]
    return common, first, last


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers low[i] .. low[i] + n[i] - 1, for one i after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(low - ends + n, n)


def _sizes(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


class _Rows:
    """An array that grows at its end."""

    def __init__(self, *shape: int) -> None:
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            more = max(len(self.held), len(rows))
            self.held = np.concatenate([self.held, np.zeros((more, *self.held.shape[1:]), np.int64)])
        self.held[self.n: self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner(dict):
    """Chunk -> number of its alignment, whose figures lie in ``sums``, ``pairs`` and ``groups``."""

    def __init__(self, path_a: str, pattern: str, path_b: str) -> None:
        super().__init__()
        self.a = Splitter(path_a, pattern)
        byte = {chr(c): b for b, c in self.a.alphabet.items()}
        names = {i: t for t, i in self.a.library.get_vocab(with_added_tokens=False).items()}
        bytes_a = [bytes(map(byte.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)]
        self.fast = self._by_ranks(path_a, pattern, bytes_a)
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or b.encode("a  b", out_type=str)[0][0] != "▁":
            raise ValueError("a model that adds a space and has no piece over the start of a word is asked for")
        self.bytes_a = bytes_a
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = _sizes(self.bytes_a), _sizes(self.bytes_b)
        self.vocabulary = n = max(len(bytes_a), len(pieces))
        self.written = [f"{c}{i}" for c in ";,|" for i in range(n)]
        self.empty()

    @staticmethod
    def _by_ranks(path: str, pattern: str, names: list[bytes]):
        """The same model as ranks, if its merges come in the order of their ids, else None."""
        import json
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {a["id"] for a in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merges != sorted(set(merges)) or spec["model"].get("ignore_merges"):
            return None
        ranks = {t: i for i, t in enumerate(names) if t and i not in added}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def empty(self) -> None:
        self.clear()
        #: tokens of A and of B, groups, links; -1 tokens of A if the bytes aren't restored
        self.sums = _Rows(4)
        #: the pairs of the i-th alignment end at ends[i]
        self.pairs, self.ends = _Rows(), _Rows()
        self.groups: list[str] = []

    def encode_a(self, text: str) -> list[int]:
        if _PLAIN.search(text):
            lib = self.a.library
            words = [text[i:j] for _, (i, j) in lib.pre_tokenizer.pre_tokenize_str(text)]
        elif self.fast:
            return self.fast(text)
        else:
            words = self.a.find(text)
        return [t.id for w in words for t in self.a.library.model.tokenize(w.encode().decode("latin-1").translate(self.a.alphabet))]

    def learn(self, chunks: list[str]) -> None:
        # those without white space at an end are encoded in one go by A: nothing reaches over the spaces between them
        plain = [c for c in chunks if c.strip() is c]
        if _PLAIN.search(" ".join(plain)):
            plain = [c for c in plain if not _PLAIN.search(c)]
        known = set(plain)
        other = [c for c in chunks if c not in known] if len(plain) < len(chunks) else []
        line = "".join([" " + c for c in plain])
        stops = np.cumsum(np.fromiter((len(c) for c in plain) if line.isascii() else (len(c.encode()) for c in plain), np.int64, len(plain)) + 1)
        ids_a = np.array(self.encode_a(line) if plain else [], np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.length_a[ids_a]), stops, "right"), prepend=0)
        lists = self.b.encode(plain, num_threads=1) if plain else []
        n_b = _sizes(lists)
        ids_b = np.array(list(chain.from_iterable(lists)), np.int64)
        if not self._restored(ids_a, ids_b, line):
            other, plain = chunks, []
            ids_a, ids_b, n_a, n_b = *_NONE, *_NONE
        bad = [False] * len(plain)
        for c in other:
            a, b = np.array(self.encode_a(" " + c), np.int64), np.array(self.b.encode(c), np.int64)
            bad.append(not self._restored(a, b, " " + c))
            if bad[-1]:
                a, b = _NONE
            n_a, n_b = np.append(n_a, len(a)), np.append(n_b, len(b))
            ids_a, ids_b = np.concatenate([ids_a, a]), np.concatenate([ids_b, b])
        sums, pairs, sizes, groups = self.align(ids_a, n_a, ids_b, n_b)
        sums[np.array(bad), 0] = -1
        start = self.pairs.n
        self.update(zip([*plain, *other], range(self.sums.n, self.sums.n + len(chunks))))
        self.sums.add(sums)
        self.pairs.add(pairs)
        self.ends.add(start + np.cumsum(sizes))
        self.groups += groups

    def _restored(self, ids_a: np.ndarray, ids_b: np.ndarray, text: str) -> bool:
        raw = text.encode()
        return (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == raw
                and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == raw)

    def align(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of token lists by pairs (one behind the other, of these lengths), which cover the same bytes: sums, the linked pairs of
        ids and their number by list, the groups written out (each behind a semicolon)."""
        if not len(ids_a):
            return np.zeros((len(n_a), 4), np.int64), np.zeros(0, np.int64), np.zeros(len(n_a), np.int64), [""] * len(n_a)
        # the lists' bounds are common ends
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_a)), n_b)
        a_drives = len(ids_a) <= len(ids_b)
        short, long, of_short, n_long = (ends_a, ends_b, of_a, n_b) if a_drives else (ends_b, ends_a, of_b, n_a)
        common, first, last = intersect(short, long, (np.cumsum(n_long) - n_long)[of_short])
        n = last - first + 1
        place, partner = np.repeat(np.arange(len(short)), n), _spread(first, n)
        link_a, link_b = (place, partner) if a_drives else (partner, place)
        links = np.bincount(of_short, n, len(n_a)).astype(np.int64)
        groups = np.bincount(of_short, common, len(n_a)).astype(np.int64)
        # a group's tokens end before cut_a and cut_b
        cut_a, cut_b = np.flatnonzero(common) + 1, last[common] + 1
        if not a_drives:
            cut_a, cut_b = cut_b, cut_a
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        in_a, in_b = np.repeat(np.arange(len(cut_a)), size_a), np.repeat(np.arange(len(cut_b)), size_b)
        sign_a, sign_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
        sign_a[cut_a - size_a], sign_b[cut_b - size_b] = 0, 2
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[np.arange(len(ids_a)) + (cut_b - size_b)[in_a]] = sign_a * self.vocabulary + ids_a
        line[np.arange(len(ids_b)) + cut_a[in_b]] = sign_b * self.vocabulary + ids_b
        text = list(map(self.written.__getitem__, line.tolist()))
        bounds = [0, *np.cumsum(n_a + n_b).tolist()]
        return (np.stack([n_a, n_b, groups, links], axis=1), ids_a[link_a] << _SHIFT | ids_b[link_b], links,
                ["".join(text[i:j]) for i, j in zip(bounds, bounds[1:])])

    def portions(self, texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """``(rows, ends, index)``: the alignments of the chunks of some rows' texts, those of the i-th ending before
        ends[i].  A long text is in several portions, none of which but its first holds another row's before it.
        What was remembered before may be forgotten at the start of a portion (the numbers then start anew)."""
        rows: list[int] = []
        parts: list[list[str]] = []
        size = 0

        def ready() -> tuple[list[int], np.ndarray, np.ndarray]:
            if self.sums.n > _HELD:
                self.empty()
            chunks = list(chain.from_iterable(parts))
            index = list(map(self.get, chunks))
            gaps = [i for i, x in enumerate(index) if x is None]
            if gaps:
                self.learn(list(dict.fromkeys(map(chunks.__getitem__, gaps))))
                for i in gaps:
                    index[i] = self[chunks[i]]
            sizes, index = _sizes(parts), np.array(index, np.int64)
            out = rows[:], np.cumsum(sizes), index
            rows.clear()
            parts.clear()
            return out

        for row, text in texts:
            at = 0
            while text and at < len(text):
                cut = _CUT.search(text, at + _PART)
                end = cut.start() if cut else len(text)
                rows.append(row)
                part = text[at:end]
                words = part.split(" ")
                # equal lists: all white space is single spaces, and none is at an end
                parts.append(words if words == part.split() else _CUT.split(part))
                size += end - at
                at = end + 1
                if size >= _PART:
                    yield ready()
                    size = 0
        if rows:
            yield ready()


@lru_cache(maxsize=1)
def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    return Aligner(path_a, pattern, path_b)


class _Known:
    """What the ``head`` tells of a worker's alignments, brought up to date when there are new ones."""

    def __init__(self, known: Aligner, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.known, self.head, self.of = known, head, None

    def renew(self) -> None:
        known = self.known
        if self.of is not known.sums:
            #: best links, sum of counts, pairs that the head hasn't
            self.of, self.sums, self.rare, self.ends = known.sums, _Rows(3), _Rows(), _Rows()
        if self.sums.n == known.sums.n:
            return
        old = self.sums.n
        ends = known.ends.all[old:]
        start = known.ends.all[old - 1] if old else 0
        flat = known.pairs.all[start:]
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=start))
        keys, counts, best = self.head
        hit = np.zeros(len(flat), bool)
        sums = np.zeros((len(ends), 3), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            hit = keys[at] == flat
            np.add.at(sums[:, 0], row[hit], best[at[hit]])
            np.add.at(sums[:, 1], row[hit], counts[at[hit]])
        sums[:, 2] = np.bincount(row[~hit], minlength=len(ends))
        self.ends.add(self.rare.n + np.cumsum(sums[:, 2]))
        self.rare.add(flat[~hit])
        self.sums.add(sums)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, back = np.unique(keys, return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, back, times)
    return pair, n


def link_counts(docs: DataFrame, path_a: str, pattern: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``pair, a, b, n, best`` of every id pair that is linked: in how many links, and whether no pair of its B id is in more."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, pattern, path_b)
        tally, of = np.zeros(0, np.int64), known.sums

        def faithful(text: str) -> bool:
            return all((known.sums.all[index, 0] >= 0).all() for _, _, index in known.portions(iter([(0, text)])))

        def texts() -> Iterator[tuple[int, str]]:
            for b in batches:
                for row, text in enumerate(b.column(0)):
                    text = text.as_py()
                    # a text of several portions counts in none if one isn't restored
                    if text and (len(text) <= _PART or faithful(text)):
                        yield row, text

        def emit(pairs: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(ends, prepend=0)[: len(tally)]
            keys, n = _summed(pairs[: sizes.sum()], np.repeat(tally, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0]), pa.array(n[n > 0])], names=["pair", "n"])

        pairs, ends = known.pairs, known.ends
        for _, stops, index in known.portions(texts()):
            if of is not known.sums:
                yield from emit(pairs.all, ends.all)
                tally, of, pairs, ends = np.zeros(0, np.int64), known.sums, known.pairs, known.ends
            bad = np.add.reduceat(known.sums.all[index, 0] < 0, np.append(0, stops[:-1]))
            index = index[np.repeat(bad == 0, np.diff(stops, prepend=0))]
            tally = np.concatenate([tally, np.zeros(known.sums.n - len(tally), np.int64)])
            tally += np.bincount(index, minlength=len(tally))
        yield from emit(pairs.all, ends.all)

    sums = staged(docs.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                  .withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))), "pair-sums")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return sums.join(most, "b").select("pair", F.shiftright("pair", _SHIFT).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, ``head`` at most: whole classes of frequency (quarters of a power of two)."""
    level = F.floor(4 * F.log2("n"))
    least, total = None, 0
    for level_of, n in sorted(counts.groupBy(level).count().collect(), reverse=True):    # 4 * 63 rows at most
        total += n
        if total > head:
            break
        least = level_of
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(level >= least).select("pair", "n", F.col("best").cast("long")).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    return tuple(top.column(i).to_numpy()[order] for i in range(3))


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, head: int = 1 << 18, digest: bool = False,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of A and of B of one group after the other; with ``digest`` its SHA-256
    in lowercase hex, '' for no tokens.  n_best: links whose pair is in at least as many links of the corpus as
    any of its B id.  count_sum: these numbers of links, summed over the document's links."""
    counts = staged(link_counts(docs, path_a, pattern, path_b, text_col), "pair-counts")
    common = docs.sparkSession.sparkContext.broadcast(_head(counts, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, pattern, path_b)
        more = _Known(known, common.value)
        for b in batches:
            sums, bad = np.zeros((b.num_rows, 6), np.int64), np.zeros(b.num_rows, bool)
            sha, lines = {}, [[] for _ in range(b.num_rows)]
            rare = [np.zeros((2, 0), np.int64)]
            sizes = np.zeros(b.num_rows, np.int64)
            pieces = ((row, text.as_py()) for row, text in enumerate(b.column(1)))
            late: dict[int, list[np.ndarray]] = {}
            for rows, stops, index in known.portions(pieces):
                more.renew()
                starts, at = np.append(0, stops[:-1]), np.array(rows)
                own = known.sums.all[index]
                bad[at] |= np.logical_or.reduceat(own[:, 0] < 0, starts)
                sums[at, :4] += np.add.reduceat(own, starts)
                sums[at, 4:] += np.add.reduceat(more.sums.all[index, :2], starts)
                texts = list(map(known.groups.__getitem__, index.tolist()))
                for row, i, j in zip(rows, starts.tolist(), stops.tolist()):
                    line = "".join(texts[i:j])
                    if digest:
                        # each group is written behind a semicolon, the first one without it
                        sha.setdefault(row, hashlib.sha256()).update((line if row in late else line[1:]).encode())
                    else:
                        lines[row].append(line)
                    late.setdefault(row, [])
                some = np.flatnonzero(more.sums.all[index, 2])
                if len(some):
                    of = np.searchsorted(stops, some, "right")
                    n = more.sums.all[index[some], 2]
                    keys = more.rare.all[_spread(more.ends.all[index[some]] - n, n)]
                    cuts = np.searchsorted(np.repeat(of, n), np.arange(len(rows) + 1))
                    for k, row in enumerate(rows):
                        if cuts[k] < cuts[k + 1]:
                            late[row].append(keys[cuts[k]: cuts[k + 1]])
            sums[bad] = 0
            for row in sorted(late):
                if late[row] and not bad[row]:
                    own = np.concatenate(late[row])
                    rare.append(np.stack(_summed(own, np.ones(len(own), np.int64))))
                    sizes[row] = rare[-1].shape[1]
            keys, times = np.concatenate(rare, axis=1)
            rest = pa.StructArray.from_arrays([pa.array(keys), pa.array(times)], ["pair", "times"])
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            out = ["" if not sums[i, 0] else sha[i].hexdigest() if digest else "".join(lines[i])[1:] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(sums[:, c].copy()) for c in range(6)), pa.array(out, pa.string()), pa.ListArray.from_arrays(ends, rest)],
                names=["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rest"])

    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id")).alias("k"),
                        F.col(text_col).alias("text"))
    figures = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    found = staged(keyed.mapInArrow(run, f"k {keyed.schema['k'].dataType.simpleString()}, {figures}, groups string, "
                                         "rest array<struct<pair:long,times:long>>"), "alignments")
    rest = (found.select("k.row", F.explode("rest").alias("x")).select("row", "x.pair", "x.times").join(counts, "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return (found.select("k.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").join(rest, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups"))
