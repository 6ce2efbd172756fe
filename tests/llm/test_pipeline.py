import hashlib
import random
from itertools import combinations

import pyarrow as pa
import pytest
from test_lines import brute as lines_brute
from test_simhash import groups, simhash

import corpus_pipeline
from textloom.llm.bpe import default_tokenizer
from textloom.llm.common import crc_of_id
from textloom.llm.language import label_texts, train
from textloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = {"en": ["the", "house", "with", "thing", "running"], "fr": ["été", "maison", "les", "chaîne"]}
    shared = [f"a line that stands in many documents, number {i}, word for word" for i in range(4)]
    out = []
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        lines = [" ".join(r.choice(words[lang]) + r.choice(["", str(r.randint(0, 99))]) for _ in range(r.randint(3, 25))) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        t = "\n".join(lines)
        out.append((i, t, lang, "s0" if i % 3 else f"s{i % 5}", len(t)))
    out += [(200 + i, out[i * 7][1].upper() if i % 2 else out[i * 7][1], "en", "s1", 9) for i in range(12)]
    return out + [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "123 45 !!", "en", "s0", 9), out[5], (None, "the house without an id", None, None, None), (303, "the " * 3000, "en", "s1", 12000)]


def read(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs.where(crc_of_id() % 5 != 0))
    lang, score, _ = label_texts(model, pa.array([x[1] for x in rows], pa.string()))
    one = sorted(((*x[:2], x[2] or y, *x[3:]) for x, y, s in zip(rows, lang, score) if y != "und" and s >= 0.35), key=repr)
    assert read(corpus_pipeline.language(spark, docs, "")) == one and not {300, 301, 302} & {x[0] for x in one}

    docs = spark.createDataFrame(one, SCHEMA)
    two = read(corpus_pipeline.line_dedup(spark, docs, ""))
    want = lines_brute([x[:2] for x in one if x[0] is not None])
    assert sorted((x[0], hashlib.sha256(x[1].encode()).hexdigest()) for x in two if x[0] is not None) == sorted((w[0], w[3]) for w in want)
    assert all(x[4] == len(x[1]) for x in two if x[0] in {w[0] for w in want if w[2]} and x[4] is not None) and len(two) == len(one)

    docs = spark.createDataFrame(two, SCHEMA)
    three = read(corpus_pipeline.near_dedup(spark, docs, ""))
    fp = {x[1]: simhash(x[1]) for x in two}
    group = groups([(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 3], sorted(fp))
    first = {}
    for x in sorted(two, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(group[x[1]], x)
    assert three == sorted(first.values(), key=repr) and len(three) < len(two)

    docs = spark.createDataFrame(three, SCHEMA)
    copies = {x.doc_id: x.copies for x in mix(docs).collect() if x.doc_id is not None}
    four = read(corpus_pipeline.mixing(spark, docs, ""))
    assert sorted((x for x in four if x[0] is not None), key=repr) == sorted((x for x in three if x[0] is not None for _ in range(copies[x[0]])), key=repr)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    docs = spark.createDataFrame(four, SCHEMA)
    ids = [(x[0], t.encode(x[1], add_special_tokens=False).ids, x[1]) for x in four]
    five = sorted(((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for d, i, x in ids), key=repr)
    assert read(corpus_pipeline.tokenise(spark, docs, "")) == five


def test_run_and_edges(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(got) < 3 * len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    repeated = spark.createDataFrame([rows[1]] * 9 + [(None, None, None, None, None)] * 3, SCHEMA)
    assert corpus_pipeline.near_dedup(spark, repeated, "").count() == 2
    unlike = [(1, "one text of the first document here", "en", "a", 1), (1, "something else altogether stands in this row", "en", "a", 1), (5, "one text of the first document here", "en", "a", 1), (None, "", None, None, None), (None, None, None, None, None), (None, "something else altogether stands in this row", None, None, None)]
    got = read(corpus_pipeline.near_dedup(spark, spark.createDataFrame(unlike, SCHEMA), ""))
    assert [x[0] for x in got if x[1]] == [1, 1] and len(got) == 3
    assert corpus_pipeline.mixing(spark, repeated, "").count() == 9
