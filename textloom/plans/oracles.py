"""SQL of the registered queries, for another engine over the same tables.

The SQL has its own shape: tokens in rows and window functions where the plans use arrays, global ranks where they use
histograms, jump tables where they use kernels. Queries that need dynamic programming or a feedback fold have none.
"""

from __future__ import annotations

from ..operators.tagging import MODIFIERS, PREFIXES, PSEUDO_TAG, PUNCTUATION, TAG_MAP


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
EDGE = """',.?!;:''"'"""
CLEAN = f"trim(lower(token), {EDGE})"
TAG_OF = PSEUDO_TAG.format(x=CLEAN)

#: Common table expressions by name, in an order in which each uses only earlier ones.
CTE = {
    "sent": rf"""SELECT doc_id, lang, source, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_id FROM (
        SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {SPACE})), lambda x: x <> '') AS ss FROM documents)""",
    "tok": r"""SELECT doc_id, lang, source, sent_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT *, list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '') AS ts FROM sent)""",
    "w": r"""SELECT doc_id, lang, source, sent_id, lower(token) AS w, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS i FROM tok WHERE regexp_full_match(lower(token), '\p{L}+')""",
    "wp": """SELECT doc_id, lang, sent_id, w, i FROM w UNION ALL SELECT doc_id, any_value(lang), sent_id, '<END>', max(i) + 1 FROM w GROUP BY doc_id, sent_id""",
    "wg": """SELECT *, coalesce(lag(w, 1) OVER s, '<START>') AS p1, coalesce(lag(w, 2) OVER s, '<START>') AS p2 FROM wp WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY i)""",
    "vocab": """SELECT w, count(*)::BIGINT AS n FROM w WHERE lang = 'en' GROUP BY w""",
    "pairs": """SELECT p1 AS w1, w AS w2, count(*)::BIGINT AS n FROM wg WHERE lang = 'en' AND p1 <> '<START>' AND w <> '<END>' GROUP BY ALL""",
    "two": """SELECT p1 AS w1, w AS w2, count(*)::BIGINT AS n FROM wg WHERE lang = 'en' GROUP BY ALL
        UNION ALL SELECT '<START>', '<START>', count(DISTINCT (doc_id, sent_id))::BIGINT FROM w WHERE lang = 'en' HAVING count(*) > 0""",
    "three": """SELECT p2 AS w1, p1 AS w2, w AS w3, count(*)::BIGINT AS n FROM wg WHERE lang = 'en' GROUP BY ALL""",
    "lt": """SELECT doc_id, sent_id, pos, lower(token) AS w FROM tok WHERE lang = 'en'""",
    "lp": """SELECT doc_id, sent_id, pos, w FROM lt UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '</s>' FROM lt GROUP BY doc_id, sent_id""",
    "lg": """SELECT *, coalesce(lag(w, 1) OVER s, '<s>') AS p1, coalesce(lag(w, 2) OVER s, '<s>') AS p2 FROM lp WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY pos)""",
    "size": """SELECT count(DISTINCT w) + 3 AS v FROM lt""",
    "lm2": """SELECT w1, w2, n, sum(n) OVER (PARTITION BY w1)::BIGINT AS ctx FROM (SELECT p1 AS w1, w AS w2, count(*)::BIGINT AS n FROM lg GROUP BY ALL)""",
    "lm3": """SELECT w1, w2, w3, n, sum(n) OVER (PARTITION BY w1, w2)::BIGINT AS ctx FROM (SELECT p2 AS w1, p1 AS w2, w AS w3, count(*)::BIGINT AS n FROM lg GROUP BY ALL)""",
    "s2": """SELECT doc_id, sent_id, count(*) - 1 AS n_tokens, sum(log2((n + 0.05) / (ctx + 0.05 * v))) AS lp FROM lg JOIN lm2 ON p1 = w1 AND w = w2, size GROUP BY doc_id, sent_id""",
    "s3": """SELECT doc_id, sent_id, count(*) - 1 AS n_tokens, sum(log2((n + 0.05) / (ctx + 0.05 * v))) AS lp FROM lg JOIN lm3 ON p2 = w1 AND p1 = w2 AND w = w3, size GROUP BY doc_id, sent_id""",
    "split": """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (42 * 104729 + doc_id * 1000003) % 10007, doc_id) <= floor(0.8 * count(*) OVER (PARTITION BY lang)) AS is_train FROM documents""",
    "tv": """SELECT lang, w, count(*)::BIGINT AS n FROM w JOIN split USING (doc_id, lang) WHERE is_train GROUP BY ALL""",
    "idx": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, pos) - 1 AS k FROM tok WHERE lang = 'en'""",
    "mh": r"""SELECT *, coalesce(regexp_full_match(token, '\p{L}+') AND regexp_full_match(nxt, '\p{L}+') AND (42 * 104729 + doc_id * 1000003 + sent_id * 10007 + pos * 7919) % 1000 < 80, false) AS hit
        FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS nxt FROM tok WHERE lang = 'en')""",
    "mi": """SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_id, hit ORDER BY pos) AS isle FROM mh""",
    "mm": """SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, sent_id, hit, isle ORDER BY pos) % 2 = 1 AS merge FROM mi""",
    "merged": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, pos) - 1 AS token_idx FROM (SELECT *, coalesce(lag(merge) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), false) AS eaten FROM mm) WHERE NOT eaten""",
    "mt": """SELECT DISTINCT lower(token || nxt) AS token FROM merged JOIN split USING (doc_id) WHERE merge AND NOT is_train""",
    "tt": f"""SELECT doc_id, lang, sent_id, pos, lower(token) AS word, {TAG_OF} AS tag FROM tok WHERE lang = 'en'""",
    "wt": """SELECT word, tag, count(*)::BIGINT AS n FROM tt GROUP BY ALL""",
    "tags": """SELECT tag, count(*)::BIGINT AS n FROM tt GROUP BY ALL""",
    "tp": """SELECT doc_id, sent_id, pos, tag FROM tt UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '<END>' FROM tt GROUP BY doc_id, sent_id""",
    "tg": """SELECT *, coalesce(lag(tag, 1) OVER s, '<START>') AS p1, coalesce(lag(tag, 2) OVER s, '<START>') AS p2 FROM tp WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY pos)""",
    "t2": """SELECT p1 AS w1, tag AS w2, count(*)::BIGINT AS n FROM tg GROUP BY ALL UNION ALL SELECT '<START>', '<START>', count(DISTINCT (doc_id, sent_id))::BIGINT FROM tt""",
    "t3": """SELECT p2 AS w1, p1 AS w2, tag AS w3, count(*)::BIGINT AS n FROM tg GROUP BY ALL""",
    "norm": f"""SELECT tag, n, CASE WHEN r = '' THEN 'nn' ELSE r END AS normal FROM (SELECT tag, n, rtrim(regexp_replace(split_part(trim(lower(tag)), '+', 1), '{MODIFIERS}', '', 'g'), '*') AS r FROM tags)""",
    "tmap": "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TAG_MAP.items()) + ") AS t(brown, ptb)",
    "pmap": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(PREFIXES)) + ") AS t(o, prefix, ptb)",
    "rec": f"""SELECT tag, n, coalesce(direct, pre, 'NN') AS ptb, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN pre IS NOT NULL THEN 'prefix' ELSE 'default' END AS strategy FROM (
        SELECT norm.tag, n, m.ptb AS direct, (SELECT arg_min(p.ptb, p.o) FROM pmap p WHERE starts_with(norm.normal, p.prefix)) AS pre
        FROM norm LEFT JOIN tmap m ON m.brown = CASE WHEN norm.tag IN ({", ".join(map(quoted, PUNCTUATION))}) THEN norm.tag ELSE norm.normal END)""",
    "batch": """SELECT idx, w AS word, p, substr('abcdefghijklmnopqrstuvwxyz', ((idx * 11 + 5) % 26 + 1)::INT, 1) AS c FROM (SELECT *, (idx * 7 + 3) % (length(w) - 1) + 1 AS p
        FROM (SELECT w, row_number() OVER (ORDER BY md5(w || '/42'), w) - 1 AS idx FROM vocab WHERE regexp_full_match(w, '\\p{L}+') AND length(w) >= 4) WHERE idx < 1000)""".replace("\\\\", "\\"),
    "bad": """SELECT idx, word, CASE idx % 5 WHEN 0 THEN left(word, p - 1) || substr(word, p + 1) WHEN 1 THEN left(word, p - 1) || substr(word, p + 1, 1) || substr(word, p, 1) || substr(word, p + 2)
        WHEN 2 THEN left(word, p - 1) || c || substr(word, p + 1) WHEN 3 THEN left(word, p - 1) || c || substr(word, p) ELSE word || 'the' END AS corrupted FROM batch""",
    "q": """SELECT DISTINCT corrupted AS q FROM bad""",
    "qi": """SELECT q, unnest(range(0, length(q) + 1)) AS i FROM q""",
    "abc": """SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c""",
    "ea": """SELECT q, left(q, i) || substr(q, i + 2) AS cand FROM qi WHERE i < length(q)
        UNION SELECT q, left(q, i) || substr(q, i + 2, 1) || substr(q, i + 1, 1) || substr(q, i + 3) FROM qi WHERE i < length(q) - 1
        UNION SELECT q, left(q, i) || c || substr(q, i + 2) FROM qi, abc WHERE i < length(q)
        UNION SELECT q, left(q, i) || c || substr(q, i + 1) FROM qi, abc""",
    "ca": """SELECT q, cand FROM ea WHERE cand <> q AND cand IN (SELECT w FROM vocab)""",
    "di": """SELECT DISTINCT left(w, i - 1) || substr(w, i + 1) AS variant, w FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM vocab)""",
    "qd": """SELECT DISTINCT left(q, i) || substr(q, i + 2) AS variant, q FROM qi WHERE i < length(q)""",
    "cb": """SELECT q, w AS cand FROM q JOIN di ON variant = q WHERE w <> q UNION SELECT q, w FROM qd JOIN vocab ON variant = w WHERE w <> q UNION SELECT q, w FROM qd JOIN di USING (variant) WHERE w <> q""",
    "win": """SELECT doc_id, k + 1 AS out_count, list(token ORDER BY k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS win, k FROM idx""",
    "trig": """SELECT doc_id, out_count, win FROM win WHERE out_count % 5 = 0""",
    "wl": """SELECT doc_id, out_count, lower(unnest(win)) AS w, unnest(range(len(win))) AS pos FROM trig""",
    "wlp": """SELECT doc_id, out_count, pos, w FROM wl UNION ALL SELECT doc_id, out_count, max(pos) + 1, '</s>' FROM wl GROUP BY doc_id, out_count""",
    "wlg": """SELECT *, coalesce(lag(w, 1) OVER s, '<s>') AS p1, coalesce(lag(w, 2) OVER s, '<s>') AS p2 FROM wlp WINDOW s AS (PARTITION BY doc_id, out_count ORDER BY pos)""",
    "c3": """SELECT w1, w2, any_value(ctx) AS ctx FROM lm3 GROUP BY w1, w2""",
    "ws": """SELECT doc_id, out_count, count(*) - 1 AS n_tokens, sum(log2((coalesce(m.n, 0) + 0.05) / (coalesce(c3.ctx, 0) + 0.05 * v))) AS lp FROM wlg g LEFT JOIN lm3 m ON g.p2 = m.w1 AND g.p1 = m.w2 AND g.w = m.w3
        LEFT JOIN c3 ON g.p2 = c3.w1 AND g.p1 = c3.w2, size GROUP BY doc_id, out_count""",
    "ends": r"""SELECT doc_id, k, token, coalesce(sum(regexp_matches(token, '[.!?]$')::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_id FROM idx""",
    "spans": """SELECT doc_id, sent_id, min(k) AS first, max(k) AS last FROM ends GROUP BY ALL""",
    "typed": f"""SELECT doc_id, k, token, {CLEAN} AS clean FROM (SELECT doc_id, token_idx AS k, CASE WHEN merge THEN token || nxt ELSE token END AS token FROM merged)""",
    "typedends": r"""SELECT doc_id, k, coalesce(sum(regexp_matches(token, '[.!?]$')::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_id FROM typed""",
    "typedspans": """SELECT doc_id, sent_id, min(k) AS first, max(k) AS last FROM typedends GROUP BY ALL""",
    "alerts": r"""SELECT doc_id, k AS out_idx, unnest(CASE WHEN regexp_full_match(clean, '\p{L}+') AND NOT known THEN ['SEGMENT', 'SPELL'] WHEN NOT known OR length(trim(token)) >= 14 THEN ['SEGMENT'] ELSE [] END) AS alert_type
        FROM (SELECT *, clean IN (SELECT w FROM tv WHERE lang = 'en') AS known FROM typed)""",
    "aps": """SELECT s.doc_id, s.sent_id, count(*) FILTER (WHERE alert_type = 'SEGMENT') AS n_merge, count(*) FILTER (WHERE alert_type = 'SPELL') AS n_spelling, count(*) FILTER (WHERE alert_type = 'GRAMMAR') AS n_grammar
        FROM typedspans s LEFT JOIN alerts a ON a.doc_id = s.doc_id AND a.out_idx >= s.first AND a.out_idx <= s.last GROUP BY ALL""",
    "ppl": """SELECT s2.doc_id, s2.sent_id, s2.n_tokens, pow(2, least(-s2.lp / (s2.n_tokens + 1), 50)) AS bigram_ppl, pow(2, least(-s3.lp / (s3.n_tokens + 1), 50)) AS trigram_ppl FROM s2 JOIN s3 USING (doc_id, sent_id)""",
    "ver": """SELECT *, CASE WHEN trigram_ppl <= 350 THEN 'Trigram LM' WHEN bigram_ppl <= 500 THEN 'Bigram LM' ELSE 'Bigram/Trigram LM' END AS method,
        CASE WHEN trigram_ppl <= 350 THEN 'Grammatical' WHEN bigram_ppl <= 500 THEN 'Questionable' ELSE 'Ungrammatical' END AS verdict FROM ppl""",
    "av": """SELECT verdict, n_merge + n_spelling > 0 AS alerted FROM ver JOIN aps USING (doc_id, sent_id)""",
    "ho": """SELECT doc_id, lang, sent_id, pos, word AS w, tag AS gold FROM tt JOIN split USING (doc_id, lang) WHERE NOT is_train""",
    "tw": """SELECT word, tag, count(*) AS n FROM tt JOIN split USING (doc_id, lang) WHERE is_train GROUP BY ALL""",
    "mft": """SELECT word, tag FROM (SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM tw) WHERE r = 1""",
    "dft": """SELECT tag AS d FROM tw GROUP BY tag ORDER BY sum(n) DESC, tag LIMIT 1""",
    "mp": """SELECT ho.doc_id, ho.sent_id, ho.w AS word, ho.gold, coalesce(m.tag, d) AS pred FROM ho LEFT JOIN mft m ON ho.w = m.word, dft""",
    "es": r"""SELECT token AS w, CASE WHEN lower(token) IN ('de', 'la', 'el', 'en', 'y', 'los', 'las', 'del', 'al', 'un', 'una') THEN 'DET' WHEN regexp_matches(token, 'ar[.,]?$') THEN 'VERB' ELSE 'NOUN' END AS upos,
        CASE WHEN regexp_matches(token, 'as[.,]?$') THEN 'Gender=Fem|Number=Plur' WHEN regexp_matches(token, 'os[.,]?$') THEN 'Gender=Masc|Number=Plur' WHEN regexp_matches(token, 'a[.,]?$') THEN 'Gender=Fem|Number=Sing'
        WHEN regexp_matches(token, 'o[.,]?$') THEN 'Gender=Masc|Number=Sing' ELSE '_' END AS feats FROM tok WHERE lang = 'es'""",
    "mo": """SELECT w, upos, upos || CASE WHEN feats LIKE '%Fem%' THEN '-Fem' WHEN feats LIKE '%Masc%' THEN '-Masc' ELSE '' END || CASE WHEN feats LIKE '%Sing%' THEN '-Sg' WHEN feats LIKE '%Plur%' THEN '-Pl' ELSE '' END AS morph FROM es""",
    "gs": """SELECT lang, doc_id, sent_id, list(w ORDER BY i) AS gold, string_agg(w, '' ORDER BY i) AS token FROM w JOIN split USING (doc_id, lang) WHERE NOT is_train GROUP BY ALL""",
    "gl": """SELECT lang, max(length(w)) AS most FROM tv GROUP BY lang""",
    "gt": """SELECT DISTINCT lang, token, length(token) AS n, unnest(range(0, length(token))) AS ofs FROM gs""",
    "gc": """SELECT lang, token, ofs, unnest(range(1, least(most, n - ofs) + 1)) AS len FROM gt JOIN gl USING (lang)""",
    "gh": """SELECT gc.lang, token, ofs, len FROM gc JOIN tv ON tv.lang = gc.lang AND tv.w = substr(token, ofs + 1, len)""",
    "caps": """SELECT unnest([10, 15, 20, 25, 30, 100000]) AS cap""",
    "gj": """SELECT gt.lang, gt.token, gt.ofs, n, cap, coalesce(max(len), 1) AS len FROM gt CROSS JOIN caps LEFT JOIN gh ON gh.lang = gt.lang AND gh.token = gt.token AND gh.ofs = gt.ofs AND len <= cap {capped} GROUP BY ALL""",
    "gr": """SELECT lang, token, cap, 0 AS ofs, 0 AS step, 0 AS len FROM (SELECT DISTINCT lang, token, cap FROM gj) UNION ALL
        SELECT j.lang, j.token, j.cap, j.ofs + j.len, step + 1, j.len FROM gr JOIN gj j ON j.lang = gr.lang AND j.token = gr.token AND j.cap = gr.cap AND j.ofs = gr.ofs""",
    "gp": """SELECT lang, token, cap, list(substr(token, ofs - len + 1, len) ORDER BY step) AS pred FROM gr WHERE step > 0 GROUP BY ALL""",
    "gb": """SELECT gs.lang, gs.doc_id, gs.sent_id, cap, gold, pred, list_transform(range(1, len(gold)), lambda i: list_sum(list_transform(gold[1:i], lambda x: length(x)))::BIGINT) AS g,
        list_transform(range(1, len(pred)), lambda i: list_sum(list_transform(pred[1:i], lambda x: length(x)))::BIGINT) AS p FROM gs JOIN gp USING (lang, token)""",
    "gf": """SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
        SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(p) END AS precision, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(g) END AS recall FROM gb)""",
}


def sql(needs: str, body: str, **fill: str) -> str:
    """A statement with the expressions it names and all that those use."""
    wanted = set(needs.split())
    for name in reversed(CTE):
        if name in wanted:
            words = set(CTE[name].replace("(", " ").replace(")", " ").replace(",", " ").split())
            wanted |= {n for n in CTE if n in words and n != name}
    parts = ",\n".join(f"{n} AS ({CTE[n].replace('{capped}', fill.get('capped', ''))})" for n in CTE if n in wanted)
    return f"WITH RECURSIVE {parts}\n{body}"


def scores(of: str, keys: str) -> str:
    return f"SELECT {keys}, n_tokens, round(lp, 6) AS log_prob, round(pow(2, least(-lp / (n_tokens + 1), 50)), 4) AS ppl FROM {of}"


GREEDY = "gr gp gb gf"
WHOLE = "AND cap = 100000"
REPORT = "count(*)::BIGINT AS n, round(avg((gold = pred)::INT), 9) AS exact, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1"
RWE = """SELECT {keys}, token, cand, ratio FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(cp / op, 9) DESC, cand) AS r, cp / greatest(1e-12, op) AS rr, round(cp / op, 4) AS ratio FROM (
  SELECT t.*, c.cand, (coalesce(a1.n, 0) + 0.05) / (coalesce(u1.n, 0) + 0.05 * v) * ((coalesce(a2.n, 0) + 0.05) / (coalesce(u2.n, 0) + 0.05 * v)) AS op,
         (coalesce(b1.n, 0) + 0.05) / (coalesce(u1.n, 0) + 0.05 * v) * ((coalesce(b2.n, 0) + 0.05) / (coalesce(u3.n, 0) + 0.05 * v)) AS cp
  FROM t JOIN cb2 c ON c.q = t.w LEFT JOIN pairs a1 ON a1.w1 = t.p AND a1.w2 = t.w LEFT JOIN pairs a2 ON a2.w1 = t.w AND a2.w2 = t.x LEFT JOIN pairs b1 ON b1.w1 = t.p AND b1.w2 = c.cand
  LEFT JOIN pairs b2 ON b2.w1 = c.cand AND b2.w2 = t.x LEFT JOIN vocab u1 ON u1.w = t.p LEFT JOIN vocab u2 ON u2.w = t.w LEFT JOIN vocab u3 ON u3.w = c.cand, vs)) WHERE r = 1 AND rr >= 8 AND ratio > 1"""
RWE_CTE = r""", t AS ({source}), vs AS (SELECT count(*) AS v FROM vocab), q2 AS (SELECT DISTINCT w AS q FROM t),
 qd2 AS (SELECT DISTINCT left(q, i - 1) || substr(q, i + 1) AS variant, q FROM (SELECT q, unnest(range(1, length(q) + 1)) AS i FROM q2)),
 cb2 AS (SELECT q, w AS cand FROM q2 JOIN di ON variant = q WHERE w <> q UNION SELECT q, w FROM qd2 JOIN vocab ON variant = w WHERE w <> q UNION SELECT q, w FROM qd2 JOIN di USING (variant) WHERE w <> q)
"""
RWE_TOK = rf"""SELECT doc_id, sent_id, pos, token, {CLEAN} AS w, lower(coalesce(lag(token) OVER s, '<s>')) AS p, lower(coalesce(lead(token) OVER s, '</s>')) AS x FROM tok WHERE lang = 'en' WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY pos)"""
RWE_WIN = rf"""SELECT doc_id, out_count, pos, token, {CLEAN} AS w, lower(CASE WHEN pos > 0 THEN win[pos] ELSE '<s>' END) AS p, lower(CASE WHEN pos + 1 < len(win) THEN win[pos + 2] ELSE '</s>' END) AS x
 FROM (SELECT doc_id, out_count, win, unnest(win) AS token, unnest(range(len(win))) AS pos FROM trig) WHERE regexp_full_match(token, '\p{{L}}+')"""
GATE = r" WHERE regexp_full_match(w, '\p{L}+') AND length(w) >= 2"


def rwe(source: str, keys: str, needs: str, wrap: str = "{}") -> str:
    return sql(needs, "").rstrip() + RWE_CTE.format(source=f"SELECT * FROM ({source}){GATE}") + wrap.format(RWE.format(keys=keys))


def fixed(found: str, method: str) -> str:
    return f"""SELECT q AS token, coalesce(cand, q) AS fixed, CASE WHEN cand IS NULL THEN 'none' ELSE '{method}' END AS method FROM q LEFT JOIN (
      SELECT q, cand FROM (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY n DESC, cand) AS r FROM {found} JOIN vocab ON cand = w WHERE q NOT IN (SELECT w FROM vocab)) WHERE r = 1) b USING (q)"""


SQL = {
    "tokens_by_lang": sql("tok", "SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM tok GROUP BY lang"),
    "sentence_stats": sql("tok", "SELECT lang, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens, max(n) AS longest, count(*) FILTER (WHERE n <= 22) AS n_short FROM (SELECT lang, doc_id, sent_id, count(*) AS n FROM tok GROUP BY ALL) GROUP BY lang"),
    "first_sentences_300": sql("sent", "SELECT doc_id, sent_id, sentence FROM sent WHERE lang = 'en' ORDER BY doc_id, sent_id LIMIT 300"),
    "split_80_20": sql("split", "SELECT doc_id, is_train FROM split WHERE lang = 'en'"),
    "sampled_passages": sql("sent", """, p AS (SELECT doc_id, source, list(sentence ORDER BY sent_id) AS s, least(5 + (42 * 104729 + doc_id * 1000003) % 4, count(*)) AS want FROM sent WHERE source = 'src3' GROUP BY doc_id, source)
      SELECT doc_id, source, want::BIGINT AS n_sentences, replace(replace(replace(replace(array_to_string(s[b:b + want - 1], ' '), ' ,', ','), ' .', '.'), ' !', '!'), ' ?', '?') AS passage
      FROM (SELECT *, ((43 * 104729 + doc_id * 1000003) % 1000003) % (len(s) - want + 1) + 1 AS b FROM p)"""),
    "vocab_top_100": sql("vocab", "SELECT w, n FROM vocab ORDER BY n DESC, w LIMIT 100"),
    "conversation_sentences": rf"""SELECT conv_id, count(*) AS n_sentences, sum(len(regexp_split_to_array(s, '\s+')))::BIGINT AS n_tokens FROM (SELECT conv_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), {SPACE}) AS s FROM conversations) WHERE s <> '' GROUP BY conv_id""",
    "conllu_tokens": sql("es", "SELECT upos, feats, count(*) AS n, count(DISTINCT w) AS n_words FROM es GROUP BY ALL"),
    "morph_tags": sql("mo", "SELECT morph, count(*) AS n FROM mo GROUP BY ALL"),
    "out_sentences": sql("spans", "SELECT * FROM spans"),
    "unigram_counts_en": sql("vocab", "SELECT w, n FROM vocab"),
    "bigram_counts_en": sql("two", "SELECT w1, w2, n FROM two"),
    "trigram_counts_en": sql("three", "SELECT w1, w2, w3, n FROM three"),
    "bigram_counts_es": sql("two", "SELECT w1, w2, n FROM two").replace("lang = 'en'", "lang = 'es'"),
    "spelling_pairs": sql("pairs", "SELECT w1, w2, n FROM pairs"),
    "lm_vocab_minfreq": sql("lt", "SELECT w, count(*) AS n FROM lt GROUP BY w HAVING count(*) >= 3"),
    "lm_bigram_counts": sql("lm2", "SELECT w1, w2, n, ctx FROM lm2"),
    "lm_trigram_counts": sql("lm3", "SELECT w1, w2, w3, n, ctx FROM lm3"),
    "lm_context_counts": sql("c3", "SELECT w1, w2, ctx FROM c3"),
    "deletion_index": sql("di", "SELECT variant, w FROM di"),
    "lm_bigram_prob": sql("lm2 size", "SELECT w1, w2, round((n + 0.05) / (ctx + 0.05 * v), 10) AS p FROM lm2, size"),
    "sentence_bigram_ppl": sql("s2", scores("s2", "doc_id, sent_id")),
    "sentence_trigram_ppl": sql("s3", scores("s3", "doc_id, sent_id")),
    "heldout_ppl": sql("lt split", """, tr AS (SELECT lt.* FROM lt JOIN split USING (doc_id) WHERE is_train), voc AS (SELECT w FROM tr GROUP BY w), sz AS (SELECT count(*) + 3 AS v FROM voc),
      trp AS (SELECT doc_id, sent_id, pos, w FROM tr UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '</s>' FROM tr GROUP BY doc_id, sent_id),
      trg AS (SELECT coalesce(lag(w) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '<s>') AS w1, w AS w2 FROM trp), b AS (SELECT w1, w2, count(*) AS n FROM trg GROUP BY ALL), c AS (SELECT w1, sum(n) AS ctx FROM b GROUP BY w1),
      te AS (SELECT doc_id, sent_id, pos, CASE WHEN voc.w IS NULL THEN '<UNK>' ELSE lt.w END AS w FROM lt JOIN split USING (doc_id) LEFT JOIN voc ON voc.w = lt.w WHERE NOT is_train),
      tep AS (SELECT * FROM te UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '</s>' FROM te GROUP BY doc_id, sent_id),
      teg AS (SELECT doc_id, sent_id, coalesce(lag(w) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '<s>') AS w1, w AS w2 FROM tep),
      s AS (SELECT doc_id, sent_id, count(*) - 1 AS n_tokens, sum(log2((coalesce(n, 0) + 0.05) / (coalesce(ctx, 0) + 0.05 * v))) AS lp FROM teg LEFT JOIN b USING (w1, w2) LEFT JOIN c USING (w1), sz GROUP BY doc_id, sent_id)
      """ + scores("s", "doc_id, sent_id")),
    "local_window_logprob": sql("lm2 size", """, c2 AS (SELECT w1, any_value(ctx) AS ctx FROM lm2 GROUP BY w1), o AS (SELECT a.doc_id, a.sent_id, a.pos, b.pos AS j, b.w FROM lt a JOIN lt b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2),
      op AS (SELECT * FROM o UNION ALL SELECT doc_id, sent_id, pos, max(j) + 1, '</s>' FROM o GROUP BY doc_id, sent_id, pos),
      og AS (SELECT doc_id, sent_id, pos, coalesce(lag(w) OVER (PARTITION BY doc_id, sent_id, pos ORDER BY j), '<s>') AS w1, w AS w2 FROM op),
      s AS (SELECT doc_id, sent_id, pos, count(*) - 1 AS n_tokens, sum(log2((coalesce(n, 0) + 0.05) / (coalesce(c2.ctx, 0) + 0.05 * v))) AS lp FROM og LEFT JOIN lm2 USING (w1, w2) LEFT JOIN c2 USING (w1), size GROUP BY doc_id, sent_id, pos)
      """ + scores("s", "doc_id, sent_id, pos")),
    "local_window_replaced": sql("lm2 size", """, c2 AS (SELECT w1, any_value(ctx) AS ctx FROM lm2 GROUP BY w1), o AS (SELECT a.doc_id, a.sent_id, a.pos, b.pos AS j, CASE WHEN b.pos = a.pos THEN 'the' ELSE b.w END AS w FROM lt a JOIN lt b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2),
      op AS (SELECT * FROM o UNION ALL SELECT doc_id, sent_id, pos, max(j) + 1, '</s>' FROM o GROUP BY doc_id, sent_id, pos),
      og AS (SELECT doc_id, sent_id, pos, coalesce(lag(w) OVER (PARTITION BY doc_id, sent_id, pos ORDER BY j), '<s>') AS w1, w AS w2 FROM op),
      s AS (SELECT doc_id, sent_id, pos, count(*) - 1 AS n_tokens, sum(log2((coalesce(n, 0) + 0.05) / (coalesce(c2.ctx, 0) + 0.05 * v))) AS lp FROM og LEFT JOIN lm2 USING (w1, w2) LEFT JOIN c2 USING (w1), size GROUP BY doc_id, sent_id, pos)
      """ + scores("s", "doc_id, sent_id, pos")),
    "word_probability": sql("vocab", "SELECT w, round((n + 1) / (sum(n) OVER () + count(*) OVER ()), 12) AS p FROM vocab"),
    "seg_trigram_probability": sql("three two vocab", "SELECT three.w1, three.w2, w3, round((three.n + 1) / (coalesce(two.n, 0) + (SELECT count(*) FROM vocab) + 1), 12) AS p FROM three LEFT JOIN two ON two.w1 = three.w1 AND two.w2 = three.w2"),
    "segment_candidates": sql("mt tv", """, st AS (SELECT token, unnest(range(0, length(token))) AS start FROM mt), pc AS (SELECT token, start, unnest(range(1, length(token) - start + 1)) AS len FROM st)
      SELECT token, start, substr(token, start + 1, len) AS piece FROM pc WHERE substr(token, start + 1, len) IN (SELECT w FROM tv WHERE lang = 'en')"""),
    "greedy_segment_distinct": sql("mt tv", """, st AS (SELECT token, unnest(range(0, length(token))) AS ofs FROM mt), pc AS (SELECT token, ofs, unnest(range(1, length(token) - ofs + 1)) AS l FROM st),
      j AS (SELECT token, ofs, coalesce(max(length(w)), 1) AS len FROM pc LEFT JOIN tv ON w = substr(token, ofs + 1, l) AND lang = 'en' GROUP BY token, ofs),
      r AS (SELECT token, 0 AS ofs, 0 AS step, 0 AS len FROM mt UNION ALL SELECT j.token, j.ofs + j.len, step + 1, j.len FROM r JOIN j ON j.token = r.token AND j.ofs = r.ofs)
      SELECT token, string_agg(substr(token, ofs - len + 1, len), ' ' ORDER BY step) AS words FROM r WHERE step > 0 GROUP BY token"""),
    "tag_counts": sql("wt", "SELECT word, tag, n FROM wt"),
    "tag_bigrams": sql("t2", "SELECT w1, w2, n FROM t2"),
    "tag_trigrams": sql("t3", "SELECT w1, w2, w3, n FROM t3"),
    "emission_prob": sql("wt tags", "SELECT word, tag, round((wt.n + 1) / (tags.n + (SELECT count(DISTINCT word) FROM wt)), 12) AS p FROM wt JOIN tags USING (tag)"),
    "transition_prob": sql("t3 t2 tags", "SELECT t3.w1, t3.w2, w3, round((t3.n + 1) / (coalesce(t2.n, 0) + (SELECT count(*) FROM tags) + 1), 12) AS p FROM t3 LEFT JOIN t2 ON t2.w1 = t3.w1 AND t2.w2 = t3.w2"),
    "possible_tags": sql("wt", "SELECT word, count(*) AS n_tags, string_agg(tag, ' ' ORDER BY tag) AS tags FROM wt GROUP BY word"),
    "single_word_tag": sql("wt tags t2 t3", """, f AS (SELECT tag, n AS tn, coalesce((SELECT n FROM t3 WHERE w1 = '<START>' AND w2 = '<START>' AND w3 = tag), 0) AS s3, coalesce((SELECT n FROM t3 WHERE w1 = '<START>' AND w2 = tag AND w3 = '<END>'), 0) AS e3,
        coalesce((SELECT n FROM t2 WHERE w1 = '<START>' AND w2 = tag), 0) AS e2, (SELECT n FROM t2 WHERE w1 = '<START>' AND w2 = '<START>') AS s2, (SELECT count(*) FROM tags) AS t, (SELECT count(DISTINCT word) FROM wt) AS v FROM tags),
      s AS (SELECT word, tag, ln((n + 1) / (tn + v)) + ln((s3 + 1) / (s2 + t + 1)) + ln((e3 + 1) / (e2 + t + 1)) AS score FROM wt JOIN f USING (tag))
      SELECT word, tag, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, tag) AS r FROM s) WHERE r = 1"""),
    "most_frequent_tag": sql("wt", "SELECT word, tag FROM (SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM wt) WHERE r = 1"),
    "mft_predictions": sql("mp", "SELECT word, pred, count(*) AS n FROM mp GROUP BY ALL"),
    "tag_normalise": sql("norm", "SELECT tag, normal, n FROM norm"),
    "tag_reconcile": sql("rec", "SELECT tag, ptb, strategy, n FROM rec"),
    "tag_coverage": sql("rec", """SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE strategy = 'direct'), 0)::BIGINT AS n_direct, coalesce(sum(n) FILTER (WHERE strategy = 'prefix'), 0)::BIGINT AS n_prefix, coalesce(sum(n) FILTER (WHERE strategy = 'default'), 0)::BIGINT AS n_default,
      round(100.0::DOUBLE * n_direct / total, 6) AS direct_pct, round(100.0::DOUBLE * n_prefix / total, 6) AS prefix_pct, round(100.0::DOUBLE * n_default / total, 6) AS default_pct FROM rec"""),
    "candidates_method_a": sql("ca", "SELECT q, cand FROM ca"),
    "candidates_method_b": sql("cb", "SELECT q, cand FROM cb"),
    "method_b_extra_candidates": sql("cb ca", "SELECT q, cand FROM cb EXCEPT SELECT q, cand FROM ca"),
    "candidates_vocabulary_b": sql("di vocab", """, c AS (SELECT variant AS q, w AS cand FROM di WHERE variant IN (SELECT w FROM vocab) UNION SELECT w, variant FROM di WHERE variant IN (SELECT w FROM vocab) UNION SELECT a.w, b.w FROM di a JOIN di b USING (variant))
      SELECT q, count(*) AS n FROM c WHERE q <> cand GROUP BY q"""),
    "correct_nonword": sql("cb vocab", fixed("cb", "B")),
    "correct_nonword_method_a": sql("ca vocab", fixed("ca", "A")),
    "real_word_errors": rwe(RWE_TOK, "doc_id, sent_id, pos", "tok vocab pairs di"),
    "trigger_windows": sql("trig", "SELECT doc_id, out_count, array_to_string(win, ' ') AS window FROM trig"),
    "real_word_errors_windowed": rwe(RWE_WIN, "doc_id, out_count, pos", "trig vocab pairs di", "SELECT doc_id, out_count, pos, token, cand FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, out_count ORDER BY pos) AS o FROM ({})) WHERE o = 1"),
    "inject_merges": sql("merged", "SELECT doc_id, sent_id, token_idx, token || nxt AS token, token || ' ' || nxt AS original FROM merged WHERE merge"),
    "corrupted_batch": sql("bad", "SELECT idx, word, corrupted FROM bad"),
    "tumbling_windows": sql("idx", "SELECT doc_id, k // 5 AS window_id, string_agg(token, ' ' ORDER BY k) AS window FROM idx GROUP BY ALL"),
    "window_trigram_ppl": sql("ws", scores("ws", "doc_id, out_count")),
    "grammar_anomalies": sql("ws", "SELECT doc_id, count(*) AS n_triggers, count(*) FILTER (WHERE round(pow(2, least(-lp / (n_tokens + 1), 50)), 4) > 850) AS n_flagged FROM ws GROUP BY doc_id"),
    "segment_gate": sql("merged tv", f"""SELECT token, known, NOT known OR length(trim(token)) >= 14 AS gated FROM (SELECT DISTINCT token, {CLEAN} IN (SELECT w FROM tv WHERE lang = 'en') AS known FROM (SELECT CASE WHEN merge THEN token || nxt ELSE token END AS token FROM merged))"""),
    "spell_gate": sql("tok tv", rf"""SELECT DISTINCT token, {CLEAN} AS clean FROM tok WHERE lang = 'en' AND regexp_full_match({CLEAN}, '\p{{L}}+') AND {CLEAN} NOT IN (SELECT w FROM tv WHERE lang = 'en')"""),
    "sentence_verdict_ngram": sql("ver", "SELECT doc_id, sent_id, n_tokens, round(bigram_ppl, 4) AS bigram_ppl, round(trigram_ppl, 4) AS trigram_ppl, method, verdict FROM ver"),
    "gate_alerts_per_sentence": sql("aps", "SELECT * FROM aps"),
    "gate_agreement_matrix": sql("av", "SELECT count(*) FILTER (WHERE alerted AND verdict = 'Grammatical') AS alert_grammatical, count(*) FILTER (WHERE alerted AND verdict <> 'Grammatical') AS alert_not_grammatical, count(*) FILTER (WHERE NOT alerted AND verdict = 'Grammatical') AS quiet_grammatical, count(*) FILTER (WHERE NOT alerted AND verdict <> 'Grammatical') AS quiet_not_grammatical FROM av"),
    "gate_agreement_rollup": sql("av", """SELECT alerted::VARCHAR AS alerted, verdict, count(*) AS n FROM av GROUP BY alerted, verdict UNION ALL SELECT alerted::VARCHAR, 'all', count(*) FROM av GROUP BY alerted UNION ALL SELECT 'all', 'all', count(*) FROM av"""),
    "boundary_prf_greedy": sql(GREEDY, "SELECT doc_id, sent_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM gf WHERE lang = 'en'", capped=f"WHERE gt.lang = 'en' {WHOLE}"),
    "exact_accuracy_greedy": sql(GREEDY, f"SELECT {REPORT} FROM gf WHERE lang = 'en'", capped=f"WHERE gt.lang = 'en' {WHOLE}"),
    "en_es_comparison": sql(GREEDY, f"SELECT lang, {REPORT} FROM gf GROUP BY lang", capped=f"WHERE gt.lang IN ('en', 'es') {WHOLE}"),
    "tune_max_word_length_greedy": sql(GREEDY, "SELECT max_len, n, f1 FROM (SELECT cap::INT AS max_len, count(*)::BIGINT AS n, round(avg(f1), 9) AS f1 FROM gf GROUP BY cap ORDER BY f1 DESC, cap LIMIT 1)", capped="WHERE cap < 100000").replace("gt AS (", "few AS (SELECT * FROM gs WHERE lang = 'en' ORDER BY doc_id, sent_id LIMIT 50),\ngt AS (", 1).replace("AS ofs FROM gs)", "AS ofs FROM few)").replace("FROM gs JOIN gp USING (lang, token)", "FROM few AS gs JOIN gp USING (lang, token)"),
    "pos_accuracy_mft": sql("mp", "SELECT count(*) AS n, count(*) FILTER (WHERE gold = pred) AS n_right, round(n_right / n, 9) AS accuracy FROM mp"),
    "confusion_mft": sql("mp", "SELECT gold, pred, count(*) AS n FROM mp GROUP BY ALL"),
    "upos_accuracy_morph": sql("mo", """, b AS (SELECT word, morph FROM (SELECT lower(w) AS word, morph, row_number() OVER (PARTITION BY lower(w) ORDER BY count(*) DESC, morph) AS r FROM mo GROUP BY lower(w), morph) WHERE r = 1)
      SELECT count(*) AS n, count(*) FILTER (WHERE mo.morph = b.morph) AS n_morph, count(*) FILTER (WHERE split_part(mo.morph, '-', 1) = split_part(b.morph, '-', 1)) AS n_upos FROM mo JOIN b ON lower(mo.w) = b.word"""),
    "error_source_greedy_mft": sql(GREEDY + " mft dft", f""", it AS (SELECT gold[i] AS token, coalesce(gold[i] = pred[i], false) AS same, i FROM (SELECT gold, pred, unnest(range(1, len(gold) + 1)) AS i FROM gf WHERE lang = 'en')),
      tg2 AS (SELECT same, {PSEUDO_TAG.format(x="token")} AS g, coalesce(tag, d) AS p FROM it LEFT JOIN mft ON word = token, dft)
      SELECT n_words, n_aligned, n_segmentation, n_tagging, round(100.0::DOUBLE * n_segmentation / (n_segmentation + n_tagging), 6) AS segmentation_pct, round(100.0::DOUBLE * n_tagging / (n_segmentation + n_tagging), 6) AS tagging_pct FROM (
        SELECT count(*) AS n_words, count(*) FILTER (WHERE same) AS n_aligned, count(*) FILTER (WHERE NOT same) AS n_segmentation, count(*) FILTER (WHERE same AND g <> p) AS n_tagging FROM tg2)""", capped=f"WHERE gt.lang = 'en' {WHOLE}"),
    "run_report_json": sql("ver sent", """, r AS (SELECT source, count(*) AS sentences, sum(n_tokens)::BIGINT AS tokens, count(*) FILTER (WHERE verdict = 'Grammatical') AS grammatical, count(*) FILTER (WHERE verdict = 'Questionable') AS questionable, count(*) FILTER (WHERE verdict = 'Ungrammatical') AS ungrammatical FROM ver JOIN sent USING (doc_id, sent_id) GROUP BY source)
      SELECT source, to_json(r)::VARCHAR AS report FROM r"""),
    "quality_contrast": sql("ver", "SELECT quality, verdict, count(*) AS n FROM ver JOIN labels USING (doc_id) GROUP BY ALL"),
    "model_status": sql("di vocab tv", "SELECT (SELECT count(*) FROM tv WHERE lang = 'en') AS segment_vocabulary, (SELECT count(*) FROM vocab) AS spelling_vocabulary, (SELECT max(length(w)) FROM vocab) AS longest_word, (SELECT count(DISTINCT variant) FROM di) AS deletion_keys"),
}
