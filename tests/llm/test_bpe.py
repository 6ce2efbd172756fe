import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.bpe import Codec, decode, default_tokenizer, digest, encode_decode
from textloom.llm.common import raw_text

TEXTS = [
    "", None, " ", "\n\n a", "it's a dog's 'life ?'s !'x ,;b", "x \nA  B\t\tC \r\n d", "été naïve 日本語   x", "<|endoftext|> a<|endoftext|>b ?<|endoftext|>",
    "aaaa" * 500, "don't''s '''ll 'LL", "a1b2 3c.4d-5e_6f", "word " * 3000, "\x00\x01\x1c \x1d a\x85b", "🙂🙂 ok", "it's", "a?'s", "x 's",
]

CODEC: dict = {}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_matches_the_library(spark):
    t = library()
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(0, "", "again")], "doc_id long, text string, ids string")
    got = digest(encode_decode(df)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), TEXTS[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_alone(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    enc = encode_decode(df)
    assert {r.doc_id: r.decoded for r in decode(enc).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].decoded == ""


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abzqs'’ \n\t.,;?!<|>0123éßñ日-_=") + ["<|endoftext|>", "'s", "'ll"]), max_size=30).map("".join), min_size=1, max_size=4))
def test_any_text(texts):
    import pyarrow as pa

    if not CODEC:
        CODEC.update(codec=Codec(default_tokenizer()), library=library())
    codec, t = CODEC["codec"], CODEC["library"]
    ids, off = codec.encode(*raw_text(pa.array(texts)))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert codec.decode(ids, off) == [t.decode(w, skip_special_tokens=False) for w in want]
