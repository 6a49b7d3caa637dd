import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from conftest import SF_SMALL
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from termlink.llm import alignment

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def alphabet():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


def brute(rows):
    """Whole texts by the libraries, all pairs of tokens, groups by sets of offsets."""
    lib, model, char = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alphabet()
    lib.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw_a = [bytes(char[c] for c in lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((doc_id, [], [], 0, "", []))
            continue

        def ranges(raw):
            out, at = [], 0
            for r in raw:
                out.append((at, at + len(r)))
                at += len(r)
            return out
        at_a, at_b = ranges(raw_a), ranges(raw_b)
        links, j = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and at_b[k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, lo = [], 0
        ia = ib = 0
        for cut in cuts:
            ga, gb = [], []
            while ia < len(a) and at_a[ia][1] <= cut:
                ga.append(str(a[ia]))
                ia += 1
            while ib < len(b) and at_b[ib][1] <= cut:
                gb.append(str(b[ib]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((doc_id, a, b, len(groups), ";".join(groups), links))
    counts = Counter(x for d in docs for x in d[5])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d[0], len(d[1]), len(d[2]), d[3], len(d[5]), sum(counts[x] == most[x[1]] for x in d[5]), sum(counts[x] for x in d[5]), d[4])
                   for d in docs), key=str)


def result(docs, **options):
    return sorted((tuple(r) for r in alignment.align(docs, A, PATTERN, B, **options).collect()), key=str)


def test_all_documents_with_and_without_a_head(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want]
    for head in (100, 0):
        assert result(docs.repartition(3), head=head, digest=True) == hashed


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "a▁b", "▁", "x <|endoftext|> <s> </s> <unk><0x41>y", "it's we'll I'M",
       "日本語のテキスト 日本", "🙂🙂 z​", "  a b 　c", "tab\there \x1c x \x85 y", "é é ﬁ Ⅳ", "\x00 \x01a", "12345 6.7  8", "՘౜ Ᲊ꟎"]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (0, "again and again"), (0, "again and again")]
    rows += [(100, "ab" * 30_000), (101, "ab cd " * 300_000), (102, "ab cd " * 300_000 + "▁"), (104, "▁ " + "ab cd " * 300_000), (103, "x " * 10 + "▁ ab cd")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, pair string, n int").repartition(3)
    want = brute(rows)
    assert result(docs) == want
    assert result(docs, head=5) == want
    assert result(docs.limit(0)) == []


def test_chunks_join_to_whole_texts():
    known = alignment.Aligner(A, PATTERN, B)
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "don't", "Haus", "été", "日本", "9", ".", "--", "​", "\x1c", "🙂", "_", "'s"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    lib = Tokenizer.from_file(A)
    for text in texts:
        chunks = alignment._CUT.split(text)
        assert [i for c in chunks for i in known.encode_a(" " + c)] == lib.encode(" " + text, add_special_tokens=False).ids
        assert [i for c in chunks for i in known.b.encode(c)] == known.b.encode(text)


def groups_of(known, text):
    return "".join(known.groups[i] for _, _, index in known.portions(iter([(0, text)])) for i in index)


def test_remembered_alignments_are_forgotten_in_parts(monkeypatch):
    known = alignment.Aligner(A, PATTERN, B)
    text = " ".join(f"w{i} {i}" for i in range(300))
    whole = groups_of(known, text)
    monkeypatch.setattr(alignment, "_PART", 7)
    monkeypatch.setattr(alignment, "_HELD", 5)
    assert groups_of(known, text) == whole and known.sums.n < 50


def test_ranks_and_merges_agree():
    known = alignment.Aligner(A, PATTERN, B)
    assert known.fast is not None
    texts = [t for t in ODD if t] + ["".join(random.Random(i).choices("abcdeimnorst ABéß19'-.", k=40)) for i in range(300)]
    fast = [known.encode_a(t) for t in texts]
    known.fast = None
    assert [known.encode_a(t) for t in texts] == fast


@given(st.lists(st.tuples(st.sets(st.integers(1, 200)), st.sets(st.integers(1, 200))), min_size=1, max_size=4))
def test_galloping_equals_all_pairs(lists):
    """Several lists, one behind the other."""
    lists = [(sorted(x | {201}), sorted(y | {201})) for x, y in lists]
    short = np.array([201 * k + e for k, (x, _) in enumerate(lists) for e in x])
    long = np.array([201 * k + e for k, (_, y) in enumerate(lists) for e in y])
    begin = np.cumsum([0] + [len(y) for _, y in lists])
    common, first, last = alignment.intersect(short, long, np.repeat(begin[:-1], [len(x) for x, _ in lists]))
    assert common.tolist() == [e in set(long.tolist()) for e in short.tolist()]
    starts = [0, *long.tolist()]
    for i, e in enumerate(short.tolist()):
        s = short[i - 1] if i else 0
        assert list(range(first[i], last[i] + 1)) == [j for j in range(len(long)) if starts[j] < e and long[j] > s]


def test_a_hot_pair_and_many_rare_ones(spark):
    rows = [(i, f"the the {i * 7919}") for i in range(500)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), head=3) == brute(rows)
