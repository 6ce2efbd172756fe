"""Hand-computed fixtures and brute force for the corpus operators."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import grams, with_case_of
from textloom.operators import counts, decoding, evaluation, grammar, language_model, live, simulate, spelling, tagging, verdict
from textloom.sources import corpus

LM = ["the dog barked at the cat", "the cat sat on the mat", "a dog chased the cat"]
START, END = counts.START, counts.END


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(0, i, s.split()) for i, s in enumerate(LM)], "doc_id long, sent_id long, tokens array<string>")
    return df.cache()


@pytest.fixture(scope="module")
def words(rows):
    return counts.word_arrays(rows)


@pytest.fixture(scope="module")
def model(words):
    return decoding.word_model(counts.unigrams(words), counts.bigrams(words), counts.count_grams(words, F.col("words"), 3))


def scores(spark, model, sentence):
    df = spark.createDataFrame([(1, 0, sentence.split())], "doc_id long, sent_id long, tokens array<string>")
    r = language_model.score(model, language_model.known(language_model.lowered(df), model.vocab) if sentence else language_model.lowered(df)).first()
    return r.log_prob, r.ppl


def test_language_model(spark, rows):
    two, three = language_model.train(rows, 2, 0.1), language_model.train(rows, 3, 0.1)
    assert two.size == 13
    p = {(r.w1, r.w2): r.p for r in two.probs.select("w1", "w2", language_model.probability(two, F.col("n"), F.col("ctx")).alias("p")).collect()}
    assert p["the", "cat"] == pytest.approx(0.492063, abs=1e-6)
    for m, text, lp, ppl in ((two, "the cat sat on the mat", -9.734103, 2.6219), (two, "a zebra sat", -14.714397, 12.8047), (three, "the cat sat on the mat", -8.842264, 2.4002), (three, "a zebra sat", -13.891275, 11.1025)):
        got = scores(spark, m, text)
        assert got[0] == pytest.approx(lp, abs=1e-5) and got[1] == pytest.approx(ppl, abs=1e-3)
    assert scores(spark, two, "") == (-math.inf, math.inf)


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "s array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(grams(F.col("s"), 3, "<", ">")).collect()]
    assert got == [[("<", "<", "a"), ("<", "a", "b"), ("a", "b", ">")], [("<", "<", ">")]]


@pytest.mark.parametrize("text,best,score", [("thecat", "the cat", -8.366312), ("thecatsat", "the cat sat", -13.859374), ("atthemat", "at the mat", -16.023075), ("thexcat", "the x cat", -15.610642), ("thedogbarkedatthecat", "the dog barked at the cat", -24.440031)])
def test_segment(model, text, best, score):
    got = decoding.segment(text, model)
    assert " ".join(got[0]) == best and got[1] == pytest.approx(score, abs=1e-5)


def test_segment_equals_enumeration(model):
    def ways(t):
        if not t:
            yield []
        for w in model.candidates(t, 0) or ([t[0]] if t else []):
            for rest in ways(t[len(w) :]):
                yield [w, *rest]

    def score(path):
        seq = [START, START, *path, END]
        return sum(math.log(model.word(w)) for w in path) + sum(math.log(model.after(c, a, b)) for a, b, c in zip(seq, seq[1:], seq[2:]))

    for text in ("acatsat", "amatonadog", "onatthecat", "xacat"):
        assert decoding.segment(text, model)[1] == pytest.approx(max(score(p) for p in ways(text)))
    assert decoding.segment("", model) == ([], 0.0)
    assert decoding.greedy("thecatsatx", model.one) == ["the", "cat", "sat", "x"]


def test_adapter(spark, model):
    df = spark.createDataFrame([("TheCat,",), ("thexcat",), ("cat",), ("...",)], "token string")
    got = {r.token: (r.words, r.is_split) for r in decoding.adapted(df, model).collect()}
    assert got == {"TheCat,": (["the", "cat"], True), "thexcat": (["thexcat"], False), "cat": (["cat"], False), "...": (["..."], False)}


TAGGED = [[("the", "AT"), ("dog", "NN"), ("barked", "VBD")], [("the", "AT"), ("cat", "NN"), ("sat", "VBD")], [("dogs", "NNS"), ("bark", "VB")], [("the", "AT"), ("bark", "NN")]]


def test_tagger(spark):
    df = spark.createDataFrame([(s,) for s in TAGGED], "tagged array<struct<word:string,tag:string>>")
    pairs, two, three = tagging.word_tag_counts(df), tagging.tag_grams(df, 2), tagging.tag_grams(df, 3)
    tags = pairs.groupBy("tag").agg(F.sum("n").alias("n"))
    m = decoding.tag_model(pairs, tags, two, three)
    for words, best, score in (("the bark", "AT NN", -5.757027), ("bark", "VB", -5.480639), ("the zebra sat", "AT NN VBD", -8.529616), ("dogs bark", "NNS VB", -6.887553)):
        got = decoding.viterbi(words.split(), m)
        assert " ".join(got[0]) == best and got[1] == pytest.approx(score, abs=1e-5)
        every = [sum(math.log(m.emit(w, t)) for w, t in zip(words.split(), p)) + sum(math.log(m.move(*x)) for x in zip((START, START, *p), (START, *p, END), (*p, END))) for p in itertools.product(*(m.possible(w) for w in words.split()))]
        assert got[1] == pytest.approx(max(every))
    one = {r.word: r.tag for r in tagging.single_word_tag(pairs, tags, three, two).collect()}
    assert one["bark"] == "VB"
    p = tagging.transition(three, two, tags).groupBy("w1", "w2").agg(F.sum("p").alias("s")).collect()
    assert all(r.s <= 1 + 1e-9 for r in p)
    assert {r.word: r.tag for r in counts.most_frequent_tag(pairs).collect()}["bark"] == "NN"


PAIRS = {"nn": "NN", "vbz": "VBZ", "at": "DT", "jj": "JJ", "cs": "IN", ".": ".", "nn-tl": "NN", "np-hl": "NNP", "in+at": "IN", "vbd-xyz": "VBD", "unknown_foo_tag": "NN", "*": "NN", "bedz-hl": "VBD", "(-hl": "(", "nn$": "NN", "fw-nn": "NN", "": "NN", None: "NN"}


def test_tag_map(spark):
    df = spark.createDataFrame([(k,) for k in PAIRS], "tag string")
    r = tagging.reconcile("tag")
    got = {x.tag: (x.t, x.s) for x in df.select("tag", r["tag"].alias("t"), r["strategy"].alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == PAIRS
    assert [got[k][1] for k in ("nn$", "fw-nn", "", "*", ".")] == ["prefix", "default", "default", "direct", "direct"]
    assert df.select(tagging.morphology(F.lit("NOUN"), F.lit("Case=Nom|Gender=Fem|Number=Plur")).alias("m"), tagging.morphology(F.lit("ADV"), F.lit("_")).alias("n")).first() == ("NOUN-Fem-Pl", "ADV")
    c = tagging.coverage(df).first()
    assert c.total == len(PAIRS) and c.n_direct + c.n_prefix + c.n_default == len(PAIRS)


VOCAB = {"apple": 5, "ape": 2, "maple": 3, "see": 9, "sea": 4, "set": 6, "acde": 1, "the": 50, "tea": 2}


def test_spelling(spark):
    v = spark.createDataFrame(list(VOCAB.items()), "w string, n long")
    q = spark.createDataFrame([(x,) for x in ("aple", "teh", "sea", "abcd", "zzzz")], "q string")
    group = lambda df: {k: sorted(r.cand for r in df.collect() if r.q == k) for k in ("aple", "teh", "sea", "abcd", "zzzz")}
    a, b = group(spelling.candidates_a(q, v)), group(spelling.candidates_b(q, v))
    assert a == {"aple": ["ape", "apple", "maple"], "teh": ["tea", "the"], "sea": ["see", "set", "tea"], "abcd": [], "zzzz": []}
    assert b == {**a, "abcd": ["acde"]}
    t = spark.createDataFrame([(x,) for x in ("aple", "Aple,", "APLE", "teh", "sea", "abcd", "zzzz")], "token string")
    fixed = {r.token: r.fixed for r in spelling.correct_nonwords(t, v).collect()}
    assert fixed == {"aple": "apple", "Aple,": "Apple", "APLE": "APPLE", "teh": "the", "sea": "sea", "abcd": "acde", "zzzz": "zzzz"}
    got = spark.createDataFrame([("x", "Ab"), ("x", "AB"), ("x", "aB")], "w string, l string").select(with_case_of(F.lit("word"), F.col("l"))).collect()
    assert [r[0] for r in got] == ["Word", "WORD", "word"]


def test_real_word_error(spark):
    v = spark.createDataFrame([("to", 30), ("see", 20), ("sea", 10), ("the", 50)], "w string, n long")
    p = spark.createDataFrame([("to", "see", 15), ("see", "the", 12), ("the", "sea", 8)], "w1 string, w2 string, n long")
    t = spark.createDataFrame([(0, 0, 0, "sea", "to", "the"), (0, 0, 1, "see", "to", "the")], "doc_id long, sent_id long, pos long, token string, prev string, next string")
    got = spelling.real_word_errors(t, v, p).collect()
    assert [(r.pos, r.cand) for r in got] == [(0, "see")]
    assert live.ContextModel({"to": 30, "see": 20, "sea": 10, "the": 50}, {("to", "see"): 15, ("see", "the"): 12, ("the", "sea"): 8}, {}, {}, 9).real_word_error(["to", "sea", "the"], 1, 8.0) == "see"


def test_merges(spark):
    t = spark.createDataFrame([(0, 0, i, w) for i, w in enumerate("a b c d.".split())], "doc_id long, sent_id long, pos long, token string")
    got = simulate.inject_merges(t, 1000).orderBy("token_idx").collect()
    assert [r.token for r in got] == ["ab", "c", "d."] and [r.is_merge for r in got] == [True, False, False]
    assert [w for r in got for w in r.original_words] == ["a", "b", "c", "d."]


def test_trigger_skips(spark):
    sizes = [1, 1, 1, 1, 2, 1, 1, 1, 1]
    words = iter(f"w{i}" for i in range(10))
    o = spark.createDataFrame([(0, i, [next(words) for _ in range(n)]) for i, n in enumerate(sizes)], "doc_id long, token_idx long, words array<string>")
    got = simulate.trigger_windows(o).collect()
    assert [(r.out_count, r.window) for r in got] == [(10, [f"w{i}" for i in range(2, 10)])]


def test_boundaries(spark):
    df = spark.createDataFrame([("the cat sat".split(), "the catsat".split()), (["cat"], ["cat"])], "gold array<string>, pred array<string>")
    a, b = evaluation.boundary_scores(df).collect()
    assert (a.precision, a.recall) == (1.0, 0.5) and a.f1 == pytest.approx(2 / 3) and (b.precision, b.recall, b.f1) == (0, 0, 0)
    e = spark.createDataFrame([("the cat sat".split(), list("xyz"), "the catsat".split(), list("xq"))], "gold array<string>, gold_tags array<string>, pred array<string>, pred_tags array<string>")
    r = evaluation.error_sources(e).first()
    assert (r.n_words, r.n_aligned, r.n_segmentation, r.n_tagging) == (3, 1, 2, 0)


def test_grammar(spark):
    trees = spark.createDataFrame([("(S (NP (DT the) (NN dog)) (VP (VBD barked)))",), ("(S (NP (DT the) (NN cat)) (VP (VBD saw) (NP (DT a) (NN dog))))",)], "tree string")
    rules = grammar.rules(grammar.productions(trees))
    p = {(r.lhs, tuple(r.rhs)): r.p for r in rules.collect()}
    assert p["VP", ("VBD",)] == 0.5 and p["DT", ("the",)] == pytest.approx(2 / 3) and p["NN", ("cat",)] == pytest.approx(1 / 3)
    g = grammar.grammar(grammar.indexed(rules))
    ok, lp, tree = grammar.cky("the cat barked".split(), "DT NN VBD".split(), g)
    assert ok and lp == pytest.approx(-4.169925, abs=1e-5) and tree == "(S (NP (DT the) (NN cat)) (VP (VBD barked)))"
    assert grammar.cky("the zebra barked".split(), "DT NN VBD".split(), g)[1] == pytest.approx(-10.584963, abs=1e-5)
    assert grammar.cky([], [], g) == (False, -math.inf, None) and not grammar.cky(["a"] * 23, ["DT"] * 23, g)[0]
    assert list(grammar.productions_of(grammar.binarised(grammar.read_tree("(NP (DT a) (JJ big) (NN dog))"))))[:3:2] == [("NP", ["DT", "NP|<JJ-NN>"], False), ("NP|<JJ-NN>", ["JJ", "NN"], False)]
    df = spark.createDataFrame([(0, 0, "the cat barked".split(), "DT NN VBD".split()), (0, 1, ["x"] * 30, ["NN"] * 30)], "doc_id long, sent_id long, words array<string>, tags array<string>")
    assert {r.sent_id: r.status for r in grammar.parse_sentences(df, g).collect()} == {0: "valid", 1: "unparseable"}


@pytest.mark.parametrize("pcfg,tri,bi,method,result", [(-50.0, 9e9, 9e9, "PCFG Parser", "Grammatical"), (-65.0, 9e9, 9e9, "PCFG Parser", "Grammatical"), (-70.0, 350.0, 9e9, "Trigram LM", "Grammatical"), (-math.inf, 351.0, 500.0, "Bigram LM", "Questionable"), (-math.inf, 351.0, 501.0, "Bigram/Trigram LM", "Ungrammatical")])
def test_verdict(spark, pcfg, tri, bi, method, result):
    df = spark.createDataFrame([(pcfg, tri, bi)], "p double, t double, b double")
    m, v, reason = verdict.decide(F.col("p"), F.col("t"), F.col("b"))
    r = df.select(m.alias("m"), v.alias("v"), reason.alias("r")).first()
    assert (r.m, r.v) == (method, result) and r.r


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"One two. Three {i}! Four five?\nSix.", "en", "src3") for i in range(25)], "doc_id long, text string, lang string, source string")
    assert corpus.split_documents(docs).where("is_train").count() == 20
    assert corpus.first_sentences(docs, 7).count() == 7 and corpus.sentences(docs).count() == 100
    assert all(1 <= r.n_sentences <= 4 for r in corpus.passages(docs, "src3").collect())
    text = "# c\n1\tLa\tel\tDET\t_\tGender=Fem|Number=Sing\t_\t_\t_\t_\n1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n\n1\tx\tx\tNOUN\t_\t_\t_\t_\t_\t_"
    got = corpus.read_conllu(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.sent_id, r.word, r.feats) for r in got] == [(0, "La", "Gender=Fem|Number=Sing"), (1, "x", "_")]
    df = spark.createDataFrame([(1, -math.inf, "a")], "i long, x double, s string")
    corpus.write_json(df, str(tmp_path / "j"))
    assert corpus.read_json(spark, str(tmp_path / "j")).first().s == "a"
    corpus.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    corpus.save_model({"m": df}, str(tmp_path / "m"))
    assert corpus.load_model(spark, str(tmp_path / "m"), ("m",))["m"].count() == 1 and corpus.load_model(spark, str(tmp_path / "m"), ("m", "n")) is None


def test_stream_equals_batch(spark, tmp_path):
    from textloom.streaming.live_stream import stream_alerts

    model = live.ContextModel({"to": 30, "see": 20, "sea": 10, "the": 50}, {("to", "see"): 15, ("see", "the"): 12, ("the", "sea"): 8}, {}, {}, 9)
    words = "i want to sea the big to sea the man and to sea the end".split()
    rows = [(d, i, [w]) for d in (1, 2) for i, w in enumerate(words[: 15 - d])]
    df = spark.createDataFrame(rows, "doc_id long, token_idx long, words array<string>")
    config = live.EditorConfig(most_ppl=8.0)
    want = sorted(map(tuple, live.fold_alerts(df, model, config).collect()), key=repr)
    assert {r[2] for r in want} == {"GRAMMAR", "ANOMALY"}
    for n in range(3):
        df.where(F.floor(F.col("token_idx") / 5) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_alerts(stream, model, config).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("alerts").collect()), key=repr) == want


def test_greedy_rows_keep_long_sentences(spark, tmp_path):
    from textloom.plans import queries

    text = " ".join(["the cat sat"] * 20) + "."
    docs = spark.createDataFrame([(i, f"the cat sat. {text}", "en", "src3") for i in range(25)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.greedy_rows(spark, str(tmp_path)).collect()
    assert sorted(len(r.gold) for r in got) == [2] * 5 + [59] * 5  # "sat." is no alphabetic word
    assert queries.QUERIES["exact_accuracy_greedy"](spark, str(tmp_path)).first().n == 10


def test_boundaries_of_a_long_sentence(spark):
    long = ["ab"] * 20_000
    df = spark.createDataFrame([(long, [*long[:-1], "a", "b"])], "gold array<string>, pred array<string>")
    r = evaluation.boundary_scores(df).first()
    assert r.recall == 1.0 and r.precision == pytest.approx(19_999 / 20_000)


def test_sentences_of_any_length_are_tagged(spark, tmp_path):
    from textloom.plans import queries

    texts = [" ".join(["the cat sat"] * n) + "." for n in (1, 7, 8, 400)]
    spark.createDataFrame([(i, t, "en", "src3") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["viterbi_tag_sentences"](spark, str(tmp_path)).collect()
    assert {r.doc_id: len(r.tags.split()) for r in got} == {0: 3, 1: 21, 2: 24, 3: 1200}


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("typed"))
    texts = ["the cat sat on the mat. a dog chased the cat." * (1 + i % 2) for i in range(10)]
    spark.createDataFrame([(i, t, "en", "src3") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_alerts_are_those_of_the_live_pipeline(spark, typed):
    from textloom.plans import queries

    merges = simulate.inject_merges(queries.flat(spark, typed)).where("is_merge").count()
    got = queries.QUERIES["alerts_per_sentence"](spark, typed).collect()
    assert merges and sum(r.n_merge for r in got) == merges  # all words are known, so each merge is found, and nothing else is cut


def test_agreement_covers_all_sentences(spark, typed):
    from textloom.plans import queries

    m = queries.QUERIES["agreement_matrix"](spark, typed).first()
    # "mat." is corrected to "cat" and loses its full stop, so each of the ten documents is one sentence.
    assert sum(m) == 10 and m.alert_grammatical + m.alert_not_grammatical > 0


def tag_tables(spark):
    train = [[("the", "AT"), ("dog", "NN"), ("barked", "VBD")], [("the", "AT"), ("cat", "NN"), ("sat", "VBD")], [("dogs", "NNS"), ("bark", "VB")], [("the", "AT"), ("bark", "NN")]]
    rows = spark.createDataFrame([([{"word": w, "tag": t} for w, t in s],) for s in train], "tagged array<struct<word:string,tag:string>>")
    pairs = tagging.word_tag_counts(rows)
    return pairs, pairs.groupBy("tag").agg(F.sum("n").alias("n")), tagging.tag_grams(rows, 2), tagging.tag_grams(rows, 3)


def test_segment_and_tag(spark, model):
    tags = decoding.tag_model(*tag_tables(spark))
    df = spark.createDataFrame([("TheCat,",), ("thexcat",), ("?!",), ("thecatsat",)], "token string")
    got = {r.token: (r.words, r.tags, r.split_score, r.single_score) for r in decoding.segment_and_tag(df, model, tags).collect()}
    assert got["TheCat,"] == (["the", "cat"], ["AT", "NN"], 1.0, 0.0) and got["thecatsat"][:2] == (["the", "cat", "sat"], ["AT", "NN", "VBD"])
    assert got["thexcat"][0] == ["thexcat"] and got["thexcat"][2] == 0.0 and got["?!"][0] == ["?!"]
    one = decoding.full_pipeline(df.where("token = 'thecatsat'"), model, tags).first()
    assert (one.words, one.tags) == (["the", "cat", "sat"], ["AT", "NN", "VBD"])


def test_replaced_window(spark):
    df = spark.createDataFrame([(1, 0, list("abcdef"), "X"), (2, 0, ["a"], None)], "doc_id long, sent_id long, seq array<string>, r string")
    got = {(r.doc_id, r.pos): "".join(r.seq) for r in language_model.local_windows(df, replacement=F.col("r")).collect()}
    assert got == {(1, 0): "Xbc", (1, 1): "aXcd", (1, 2): "abXde", (1, 3): "bcXef", (1, 4): "cdXf", (1, 5): "deX", (2, 0): "a"}


def test_unseen_contexts_are_found(spark, rows):
    """A known context before an unseen word, and a context never seen."""
    m = language_model.train(rows, 3, 0.1)
    df = spark.createDataFrame([(1, 0, ["the", "cat", "zebra"]), (2, 0, ["zebra", "zebra"])], "doc_id long, sent_id long, seq array<string>")
    seqs = {1: ["the", "cat", "zebra"], 2: ["zebra", "zebra"]}
    count, ctx = {}, {}
    for s in LM:
        t = ["<s>", "<s>", *s.split(), "</s>"]
        for g in zip(t, t[1:], t[2:]):
            count[g] = count.get(g, 0) + 1
            ctx[g[:2]] = ctx.get(g[:2], 0) + 1
    for r in language_model.score(m, df).collect():
        t = ["<s>", "<s>", *seqs[r.doc_id], "</s>"]
        want = sum(math.log2((count.get(g, 0) + 0.1) / (ctx.get(g[:2], 0) + 0.1 * m.size)) for g in zip(t, t[1:], t[2:]))
        assert r.log_prob == pytest.approx(want)
    whole = language_model.lowered(rows)
    key = lambda df: sorted((r.sent_id, r.n_tokens, round(r.log_prob, 9)) for r in df.collect())
    assert key(language_model.score(m, whole, seen=True)) == key(language_model.score(m, whole))


def test_strategies(spark):
    vocab = spark.createDataFrame([("apple", 5), ("ape", 2)], "w string, n long")
    spelling.register("first", lambda q, v: q.select("q").crossJoin(v.select(F.col("w").alias("cand")).orderBy("w").limit(1)))
    got = spelling.correct_nonwords(spark.createDataFrame([("zzz",)], "token string"), vocab, "first").first()
    assert (got.fixed, got.method) == ("ape", "first")
    with pytest.raises(KeyError):
        spelling.correct_nonwords(vocab.select(F.col("w").alias("token")), vocab, "none such")


def test_alert_reports(spark):
    a = spark.createDataFrame([(1, 0, 0, "SEGMENT", "ab", "a b"), (1, 5, 6, "SPELL", "teh", "the")], "doc_id long, input_idx long, out_idx long, alert_type string, original string, replacement string")
    b = spark.createDataFrame([(1, 5, 4, "GRAMMAR", "sea", "see"), (2, 9, 2, "ANOMALY", "x", None)], a.schema)
    assert live.counters(a, b).first().asDict() == {"n_segment": 1, "n_spell": 1, "n_grammar": 1, "n_anomaly": 1, "n_alerts": 4}
    assert live.counters(a.limit(0), b.limit(0)).first().n_alerts == 0
    got = [(r.doc_id, r.nth, r.input_idx, r.alert_type) for r in live.newest_first(a, b).orderBy("doc_id", "nth").collect()]
    assert got == [(1, 1, 5, "SPELL"), (1, 2, 5, "GRAMMAR"), (1, 3, 0, "SEGMENT"), (2, 1, 9, "ANOMALY")]
    t = spark.createDataFrame([("token", 2.0), ("token", 4.0)], "kind string, latency_ms double")
    assert live.latency(t).first().asDict() == {"mean_token": 3.0, "max_token": 4.0, "n_token": 2, "mean_trigger": 0.0, "max_trigger": 0.0, "n_trigger": 0}


def test_confusion_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "gold string, pred string")
    assert [tuple(r) for r in evaluation.confusion_matrix(df).collect()] == [("a", 1, 1, 0), ("c", 1, 0, 0)]


def test_read_trees(spark, tmp_path):
    (tmp_path / "a.mrg").write_text("( (S (NP (DT the)\n  (NN dog))\n (VP (VBD barked)) (. .)) )\n\n(S (VP (VB be)))  stray ) \n(X (Y z)\n")
    got = sorted(r.tree for r in grammar.read_trees(spark, str(tmp_path)).collect())
    assert got == ["(S (NP (DT the) (NN dog)) (VP (VBD barked)) (. .))", "(S (VP (VB be)))"]
    assert grammar.productions(grammar.read_trees(spark, str(tmp_path))).count() == 11


def test_split_is_exact(spark):
    for n in (0, 1, 4, 5, 997):
        df = spark.range(n).select((F.col("id") * 10_007).alias("doc_id"))  # one draw for all: the border holds every id
        got = [r.doc_id for r in corpus.split_documents(df).where("is_train").collect()]
        assert sorted(got) == [i * 10_007 for i in range(math.floor(0.8 * n))]


def test_windows_in_row(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(11)]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    flat = df.select("doc_id", F.posexplode("tokens").alias("token_idx", "token"))
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    assert key(simulate.windows_in_row(df)) == key(simulate.trigger_windows(flat.select("doc_id", "token_idx", F.array("token").alias("words"))))
    assert key(simulate.tumbling_in_row(df)) == key(simulate.tumbling_windows(flat))


def test_long_sentences_are_unparseable(spark):
    rules = grammar.grammar(grammar.indexed(grammar.rules(grammar.productions(grammar.trees(spark)))))
    df = spark.createDataFrame([(1, 0, ["the"] * 23, ["DT"] * 23), (1, 1, ["the", "dog", "barked"], ["DT", "NN", "VBD"])], "doc_id long, sent_id long, words array<string>, tags array<string>")
    assert {(r.sent_id, r.status) for r in grammar.parse_sentences(df, rules).collect()} == {(0, "unparseable"), (1, "valid")}


def test_decisions(spark):
    before = spark.createDataFrame([(1, 0, "a b", False), (1, 1, "same", True), (1, 2, "c", True)], "doc_id long, sent_id long, text string, is_valid boolean")
    after = spark.createDataFrame([(1, 0, "ab", True, "PCFG Parser"), (1, 1, "Same ", True, "PCFG Parser"), (1, 2, "d", False, "Bigram LM")], "doc_id long, sent_id long, text string, is_valid boolean, method string")
    got = {r.sent_id: (r.flipped, r.decision_before, r.decision_after, r.decision_changed) for r in verdict.interactions(before, after).collect()}
    assert got == {0: (True, "Trigram LM", "PCFG Parser", True), 2: (False, "PCFG Parser", "Bigram LM", True)}


def test_grams_of_a_long_row(spark):
    """Cutting n-grams took the square of a row's length: minutes for this row."""
    import time

    row = spark.createDataFrame([(0, 0, [f"w{i % 1000}" for i in range(150_000)])], "doc_id long, sent_id long, words array<string>").withColumn("tokens", F.col("words")).cache()
    row.count()
    began = time.time()
    assert counts.count_grams(row, F.col("words"), 3).agg(F.sum("n")).first()[0] == 150_001
    assert len(row.select(grams(F.col("words"), 3, START, END).alias("g")).first().g) == 150_001
    assert tagging.rule_grams(row, 3).agg(F.sum("n")).first()[0] == 150_001
    assert time.time() - began < 60


def test_rule_tables_equal_those_of_tagged_arrays(spark):
    odd = [["The", "RUNNING", "''", "Nation.", "<START>", "is"], [], ["its", "'ly", "WALKED,", "ea", "?"], ["test"]]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(odd)], "doc_id long, sent_id long, tokens array<string>")
    of = lambda x: sorted(map(tuple, x.collect()))
    arrays = tagging.tagged(df)
    assert of(tagging.rule_counts(df).select("word", "tag", "n")) == of(tagging.word_tag_counts(arrays))
    for n in (2, 3):
        assert of(tagging.rule_grams(df, n)) == of(tagging.tag_grams(arrays, n))
    three = tagging.rule_grams(df, 3)
    assert of(tagging.bigrams_of(three)) == of(tagging.tag_grams(arrays, 2))
    assert of(tagging.tags_of(three)) == of(tagging.word_tag_counts(arrays).groupBy("tag").agg(F.sum("n").alias("n")))
    assert of(tagging.tokens_tagged(df)) == sorted((p.word.lower(), p.tag) for r in arrays.collect() for p in r.tagged)


def test_scores_by_exchange(spark, monkeypatch):
    """Against plain counting: many chunks and buckets, tokens like the markers, rows without words, contexts never seen."""
    import random
    from collections import Counter

    from textloom.operators import exchange, language_model

    rng = random.Random(3)
    pool = [f"w{i}" for i in range(30)] + ["<s>", "</s>", "the", "é", ""]
    made = lambda n: [[rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 5, 40]))] for _ in range(n)]
    train, ask = made(300), [*made(60), ["never", "seen"]]
    frame = lambda x: spark.createDataFrame([(7, i, s, s) for i, s in enumerate(x)], "doc_id long, sent_id long, tokens array<string>, seq array<string>").repartition(3, "sent_id")
    monkeypatch.setattr(exchange, "CHUNK", 200)
    monkeypatch.setattr(exchange, "BUCKET", 300)
    two = language_model.train(frame(train), 2)
    three = language_model.train(frame(train), 3, like=two)
    size = len({w.lower() for s in train for w in s}) + 3

    def brute(n, seqs):
        pad = lambda s: ["<s>"] * (n - 1) + s + ["</s>"]
        cut = lambda s: [tuple(pad(s)[i : i + n]) for i in range(len(s) + 1)]
        grams = Counter(g for s in train if s for g in cut(s))
        ctx = Counter()
        for g, m in grams.items():
            ctx[g[:-1]] += m
        return [sum(math.log2((grams[g] + 0.05) / (ctx[g[:-1]] + 0.05 * size)) for g in cut(s)) for s in seqs]

    for rows, seen in ((train, True), (ask, False)):
        rows = [s for s in rows if s or not seen]
        got = {r.sent_id: r for r in language_model.score_both(two, three, frame(rows), seen=seen).collect()}
        for i, (s, a, b) in enumerate(zip(rows, brute(2, rows), brute(3, rows), strict=True)):
            assert got[i].n_tokens == len(s)
            assert (got[i].bigram_score, got[i].trigram_score) == ((-math.inf, -math.inf) if not s else pytest.approx((a, b), abs=1e-9))
    for put in (None, "the"):
        want = {}
        for i, s in enumerate(ask):
            windows = [[put if put and x == j else s[x] for x in range(max(0, j - 2), min(len(s), j + 3))] for j in range(len(s))]
            want |= {(i, j): lp for j, lp in enumerate(brute(2, windows))}
        got = {(r.sent_id, r.pos): r.log_prob for r in language_model.score_windows(two, frame(ask), put=put).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_common_ngrams_cost_an_entry_a_chunk(spark):
    """One pair in every row was one key of a join; its rows all went to one task."""
    import pyarrow as pa

    from textloom.operators import exchange

    t = pa.table({"sent_id": pa.array(range(5000)), "seq": [["of", "the"]] * 5000, "role": pa.array([3] * 5000, pa.int32())})
    sent = list(exchange._chunk(t, 0, 4, (2, 3), "<s>", "</s>", None, None))
    assert sum(exchange._unzipped(pa.py_buffer(x[3])).size // exchange.WIDTH for x in sent if x[2] == 1) == 3 + 4 + 3  # trigrams; pairs, (<s>, <s>) among them; contexts


def test_stored_models_decode_like_dictionaries(spark, words, model, monkeypatch):
    """Models of any size: the driver gathers no row of them."""
    whole = decoding.StoredWordModel
    one, two, three = counts.unigrams(words), counts.bigrams(words), counts.count_grams(words, F.col("words"), 3)
    monkeypatch.setattr(decoding, "MODEL_ROWS", 2)
    held = decoding.stored_word_model(one, two, three)
    assert isinstance(held, whole) and (held.total, held.longest, held.size) == (model.total, model.longest, model.size)
    texts = ["thecatsat", "atthemat", "thexcat", "qqq", "thedogbarkedatthecat", "é", ""]
    for longest in (None, 3):
        local = held.local(texts, longest)
        assert [decoding.segment(t, local, longest) for t in texts] == [decoding.segment(t, model, longest) for t in texts]
    assert held.known({"cat", "xyz"}) == {"cat"}
    df = spark.createDataFrame([(t,) for t in texts], "token string")
    of = lambda m: sorted(map(str, decoding.adapted(df, m).collect()))
    assert of(held) == of(model)
    monkeypatch.undo()
    rows = spark.createDataFrame([([("a", t), ("b", "X"), ("a", "Y")],) for t in ("X", "Y", "Z", "Z")], "tagged array<struct<word:string,tag:string>>")
    pairs = tagging.word_tag_counts(rows)
    tables = pairs, pairs.groupBy("tag").agg(F.sum("n").alias("n")), tagging.tag_grams(rows, 2), tagging.tag_grams(rows, 3)
    full, stored = decoding.tag_model(*tables), decoding.stored_tag_model(*tables)
    for s in (["a", "b"], ["new", "a", "a"], ["b"]):
        assert decoding.viterbi(s, stored.local(set(s))) == decoding.viterbi(s, full)


def test_stored_context_folds_like_dictionaries(spark):
    """The fold's model of any size: the same alerts from tables as from dictionaries."""
    import random

    from textloom.operators import language_model

    rng = random.Random(5)
    pool = ["the", "see", "sea", "to", "too", "tea", "aab", "ab", "é", "éa", "bees", "bee", "a", "seas", "tow", "two"]
    seqs = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    df = spark.createDataFrame([(i // 8, i % 8, s) for i, s in enumerate(seqs)], "doc_id long, sent_id long, tokens array<string>")
    rows = counts.word_arrays(df)
    one, two, lm = counts.unigrams(rows), counts.adjacent(rows), language_model.train(df, 3)
    c = decoding.collected
    full = live.ContextModel(c(one, "w"), c(two, "w1", "w2"), c(lm.probs, "w1", "w2", "w3"), c(lm.contexts, "w1", "w2", value="ctx"), lm.size)
    held = live.context_model(one, two, lm)
    for w in [*pool, "zz", "be", "aa", "eas"]:
        assert set(held.near(w)) == full.near(w)
    outputs = spark.createDataFrame([(d, i, [rng.choice([*pool, "Sea,", "zzz"])]) for d in range(4) for i in range(60)], "doc_id long, token_idx long, words array<string>")
    config = live.EditorConfig(most_ppl=20.0, ratio=2.0)
    of = lambda m: sorted(map(str, live.fold_alerts(outputs, m, config).collect()))
    assert of(held) == of(full) and any("GRAMMAR" in x for x in of(full)) and any("ANOMALY" in x for x in of(full))


def test_tuning_gathers_the_vocabulary_once(spark, monkeypatch):
    from textloom.plans import queries

    gathered = []
    collected = decoding.collected
    monkeypatch.setattr(decoding, "collected", lambda *a, **b: gathered.append(a) or collected(*a, **b))
    assert queries.tune_max_word_length_greedy(spark, "/root/testdata/sf0.001").count() == 1
    assert len(gathered) == 1
