import public_tokenizers
from conftest import SF_SMALL
from tokenizers import Tokenizer

from termlink.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def library(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_all_documents_with_and_without_a_head(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.collect()
    want = sorted(zip([r.doc_id for r in rows], [len(r.text.encode()) for r in rows], library([r.text for r in rows])))
    for head in (1 << 18, 50, 0):
        got = token_counts.token_counts(docs, PATH, PATTERN, head=head).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_odd_texts(spark):
    texts = ["", None, "a <|endoftext|> b<|endoftext|>", "  \n\t x", "it's we'll I'M", "՘౜ Ᲊ꟎", "日本語のテキスト", "🙂🙂 z​",
             "ab" * 50_000, "x y z\x1c", "12345 6.7"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "c"), (0, "again", "c"), (0, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string").repartition(3)
    got = token_counts.token_counts(docs, PATH, PATTERN, head=3).collect()
    want = list(zip([r[0] for r in rows], library([r[1] or "" for r in rows])))
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), PATH, PATTERN).count() == 0


def test_splitters_agree_on_every_plain_character():
    s = token_counts.Splitter(PATH, PATTERN)
    for c in range(1, 0x110000):
        if not 0xD800 <= c < 0xE000 and not token_counts._PLAIN.search(chr(c)):
            text = f"a {chr(c)} 1{chr(c)}b{chr(c)}"
            own = s.find(text)
            assert own == [text[a:b] for _, (a, b) in s.library.pre_tokenizer.pre_tokenize_str(text)], hex(c)
