import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.secrets import BASE, RULES, Scanner, digest, find_secrets, trigram_query

TEXTS = [
    "", None, "password = 'abcdefghijkl' é token:short API_KEY=\"0123456789abcdef0\"", "AKIAABCDEFGHIJKLMN1 AKIA12", "x" * 5 + "deadbeefdeadbeef" + "G" + "0123456789abcde",
    "apikey=deadbeefdeadbeefdeadbeef", "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "日本 secret=日 secret:AAAAAAAAAAAA", "f" * 5000, "pa ss wo rd", "to" "ken  :  'aaaaaaaaaaaaa'", "PASSWD\" = \"abc.def_ghi-jkl=",
]


def brute(text, rules=RULES):
    out = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII | (re.IGNORECASE if r.fold else 0)):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end()))
    return ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in sorted(out))


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int")
    for r in digest(find_secrets(df)).collect():
        assert r.spans == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.n_hex == brute(TEXTS[r.doc_id], BASE).count("hex:")


def test_queries():
    assert trigram_query(BASE[2].pattern) is True
    assert trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert trigram_query("(abc|xyz)+q") == ("or", ("abc", "xyz"))
    assert trigram_query("(abc)*") is True
    assert all(trigram_query(r.pattern) is not True for r in RULES if r.kind != "hex")


def test_empty_table(spark):
    assert digest(find_secrets(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


SCAN = Scanner()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["password", "Secret", "tok", "en", "api", "_", "key", "AKIA", "abcdef01", "=", ":", "'", " ", "é", "xox", "b-", "A1" * 8, "ghp_", "."]), max_size=14).map("".join), min_size=1, max_size=4))
def test_any_text(texts):
    import pyarrow as pa

    got = [",".join(f"{RULES[i].kind}:{a}:{b}" for a, i, b in x) for x in SCAN.scan(pa.array(texts))]
    assert got == [brute(t) for t in texts]
