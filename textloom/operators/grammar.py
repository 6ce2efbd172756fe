"""Probabilistic grammar: productions from bracketed trees, binarisation, estimation, and a CKY parser with a beam."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Log2 score of a word under a tag that only the tagger proposes; nonterminals kept in a cell; unary sweeps.
UNKNOWN, BEAM, SWEEPS = -8.0, 25, 3
LONGEST = 22

#: Hand-written trees for induction; all sentences are our own.
TREES = """
(S (NP (DT the) (NN dog)) (VP (VBD barked)) (. .))
(S (NP (DT the) (NN cat)) (VP (VBD saw) (NP (DT a) (NN dog))) (. .))
(S (NP (PRP it)) (VP (VBZ is) (NP (DT a) (NN house))) (. .))
(S (NP (DT the) (JJ old) (NN man)) (VP (VBD walked) (PP (TO to) (NP (DT the) (NN sea)))) (. .))
(S (NP (DT the) (NN thing)) (VP (VBD was) (ADJP (JJ cold))) (. .))
(S (NP (NNS houses)) (VP (VBP are) (PP (IN by) (NP (DT the) (NN river)))) (. .))
(S (NP (NP (DT the) (NN end)) (PP (IN of) (NP (DT the) (NN day)))) (VP (VBD came)) (. .))
(S (NP (PRP he)) (VP (VBZ is) (VP (VBG running))) (. .))
(S (NP (DT this)) (VP (VBZ is) (NP (NP (DT the) (NN edge)) (PP (IN of) (NP (DT a) (NN wood))))) (. .))
(S (NP (NN rain)) (VP (VBD fell) (PP (IN on) (NP (DT the) (NN town)))) (. .))
(S (NP (NP (DT the) (NN king)) (CC and) (NP (DT the) (NN queen))) (VP (VBD slept)) (. .))
(S (S (NP (PRP it)) (VP (VBD rained))) (CC and) (S (NP (DT the) (NN road)) (VP (VBD was) (ADJP (JJ wet)))) (. .))
(S (NP (DT the) (NN bird)) (VP (VBD sang) (ADVP (RB loudly))) (. .))
(S (NP (NNP anna)) (VP (VBD gave) (NP (DT the) (NN book)) (PP (TO to) (NP (NNP tom)))) (. .))
(S (NP (PRP it)) (VP (VBZ is) (SBAR (IN that) (S (NP (DT the) (NN door)) (VP (VBD opened))))) (. .))
(S (NP (JJ green) (NNS leaves)) (VP (VBD covered) (NP (DT the) (NN ground))) (. .))
(S (PP (IN in) (NP (DT the) (NN morning))) (NP (DT the) (NN boat)) (VP (VBD left)) (. .))
(S (NP (DT the) (NN letter)) (VP (VBD was) (VP (VBN written) (PP (IN by) (NP (DT a) (NN friend))))) (. .))
(S (NP (DT a) (JJR larger) (NN stone)) (VP (VBD rolled) (PP (IN from) (NP (DT the) (NN hill)))) (. .))
(S (VP (VB be) (ADJP (JJ quiet))) (. .))
"""


def read_tree(text: str) -> tuple:
    """A bracketed tree as (label, children); a leaf is a string."""
    stack: list[list] = [[]]
    for token in re.findall(r"\(|\)|[^\s()]+", text):
        if token == "(":
            stack.append([])
        elif token == ")":
            node = stack.pop()
            stack[-1].append((node[0], tuple(node[1:])))
        else:
            stack[-1].append(token)
    return stack[0][0]


def binarised(tree: tuple) -> tuple:
    """Right-factored: A -> B C D becomes A -> B A|<C-D>, A|<C-D> -> C D."""
    label, children = tree
    kids = [binarised(c) if isinstance(c, tuple) else c for c in children]
    names = [c[0] if isinstance(c, tuple) else c for c in children]

    def fold(i: int, own: str) -> tuple:
        if len(kids) - i <= 2:
            return own, tuple(kids[i:])
        rest = f"{label}|<{'-'.join(names[i + 1 :])}>"
        return own, (kids[i], fold(i + 1, rest))

    return fold(0, label)


def productions_of(tree: tuple) -> Iterator[tuple[str, list[str], bool]]:
    label, children = tree
    lexical = not isinstance(children[0], tuple)
    yield label, [c if lexical else c[0] for c in children], lexical
    for c in children:
        if isinstance(c, tuple):
            yield from productions_of(c)


def productions(trees: DataFrame, column: str = "tree") -> DataFrame:
    """(lhs, rhs, lexical): every production of the binarised trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [p for t in pdf[column] if t for p in productions_of(binarised(read_tree(t)))]
            yield pd.DataFrame(rows, columns=["lhs", "rhs", "lexical"])

    return trees.select(column).mapInPandas(run, "lhs string, rhs array<string>, lexical boolean")


def trees(spark: SparkSession, n: int | None = None) -> DataFrame:
    """(tree_id, tree): the first n trees of the built-in treebank."""
    rows = [(i, t) for i, t in enumerate(TREES.strip().splitlines())]
    return spark.createDataFrame(rows[: n or None], "tree_id long, tree string")


def rules(prods: DataFrame) -> DataFrame:
    """(lhs, rhs, lexical, n, p): maximum-likelihood rule probabilities."""
    counts = prods.groupBy("lhs", "rhs", "lexical").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lhs")))


def indexed(rule_table: DataFrame) -> DataFrame:
    """(kind, lhs, b, c, logp): binary, unary and lexical rules with log2 probabilities; lexical words are lower-cased, longer rules left out."""
    kind = F.when(F.size("rhs") == 2, "binary").when((F.size("rhs") == 1) & ~F.col("lexical"), "unary").when((F.size("rhs") == 1) & F.col("lexical"), "lexical")
    first = F.when(kind == "lexical", F.lower(F.col("rhs")[0])).otherwise(F.col("rhs")[0])
    rows = rule_table.select(kind.alias("kind"), "lhs", first.alias("b"), F.get("rhs", F.lit(1)).alias("c"), F.log2(F.greatest(F.lit(1e-12), "p")).alias("logp"))
    return rows.where("kind is not null")


@dataclass
class Grammar:
    binary: dict[tuple[str, str], list[tuple[str, float]]] = field(default_factory=dict)
    unary: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    lexical: dict[str, dict[str, float]] = field(default_factory=dict)


def grammar(index: DataFrame) -> Grammar:
    """The rules for a worker. A grammar's size depends on its treebank's labels, not on the texts parsed."""
    g = Grammar()
    for r in sorted(index.collect(), key=lambda r: (r["kind"], r["lhs"], r["b"], r["c"] or "", r["logp"])):
        if r["kind"] == "binary":
            g.binary.setdefault((r["b"], r["c"]), []).append((r["lhs"], r["logp"]))
        elif r["kind"] == "unary":
            g.unary.setdefault(r["b"], []).append((r["lhs"], r["logp"]))
        else:
            g.lexical.setdefault(r["b"], {})[r["lhs"]] = r["logp"]
    return g


def _close(cell: dict, g: Grammar) -> None:
    for _ in range(SWEEPS):
        better = False
        for b, (score, _) in list(cell.items()):
            for a, logp in g.unary.get(b, ()):
                if a not in cell or score + logp > cell[a][0]:
                    cell[a] = (score + logp, (b,))
                    better = True
        if not better:
            return


def _prune(cell: dict, beam: int) -> dict:
    return cell if len(cell) <= beam else dict(sorted(cell.items(), key=lambda x: -x[1][0])[:beam])


def cky(words: list[str], tags: list[str], g: Grammar, longest: int = LONGEST, beam: int = BEAM) -> tuple[bool, float, str | None]:
    """(is valid, log2 probability, bracketed tree) of the best parse; `tags` are Treebank tags the tagger proposes.

    The root is S if it spans the words, else the best symbol that does.
    """
    n = len(words)
    if not n or n > longest:
        return False, -math.inf, None
    chart: dict[tuple[int, int], dict] = {}
    for i, (w, t) in enumerate(zip(words, tags, strict=True)):
        cell = {a: (logp, None) for a, logp in g.lexical.get(w.lower(), {}).items()}
        cell.setdefault(t, (UNKNOWN, None))
        _close(cell, g)
        chart[i, i + 1] = _prune(cell, beam)
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            j, cell = i + span, {}
            for k in range(i + 1, j):
                right = chart[k, j]
                for b, (s1, _) in chart[i, k].items():
                    for c, (s2, _) in right.items():
                        for a, logp in g.binary.get((b, c), ()):
                            s = logp + s1 + s2
                            if a not in cell or s > cell[a][0]:
                                cell[a] = (s, (k, b, c))
            if cell:
                _close(cell, g)
            chart[i, j] = _prune(cell, beam)
    top = chart[0, n]
    if not top:
        return False, -math.inf, None
    root = "S" if "S" in top else max(top, key=lambda a: top[a][0])

    def text(a: str, i: int, j: int) -> str:
        back = chart[i, j][a][1] if a in chart[i, j] else None
        if back is None:
            return f"({a} {words[i]})" if j == i + 1 else f"({a} {' '.join(words[i:j])})"
        if len(back) == 1:
            return f"({a} {text(back[0], i, j)})"
        k, b, c = back
        return f"({a} {text(b, i, k)} {text(c, k, j)})"

    return True, top[root][0], text(root, 0, n)


def parse_sentences(df: DataFrame, g: Grammar, keys: tuple[str, ...] = ("doc_id", "sent_id"), longest: int = LONGEST) -> DataFrame:
    """(keys, is_valid, status, log_prob, tree) from arrays `words` and `tags` (Treebank). Rows over the length gate never reach Python."""
    held = df.sparkSession.sparkContext.broadcast(g)
    short = df.where((F.size("words") > 0) & (F.size("words") <= longest)).select(*keys, "words", "tags")
    kinds = ", ".join(f"`{n}` {t}" for n, t in short.dtypes[: len(keys)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [cky(list(w), list(t), held.value, longest) for w, t in zip(pdf["words"], pdf["tags"], strict=True)]
            out = pdf[list(keys)].copy()
            out["is_valid"], out["log_prob"], out["tree"] = ([r[i] for r in rows] for i in range(3))
            yield out

    parsed = short.mapInPandas(run, f"{kinds}, is_valid boolean, log_prob double, tree string")
    parsed = parsed.withColumn("status", F.when(F.col("is_valid"), "valid").otherwise("unparseable"))
    return parsed.unionByName(unparseable(df.where((F.size("words") <= 0) | (F.size("words") > longest)), keys))


def unparseable(rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """The result of parse_sentences for rows that the parser doesn't take."""
    return rows.select(*keys, F.lit(False).alias("is_valid"), F.lit(float("-inf")).alias("log_prob"), F.lit(None).cast("string").alias("tree"), F.lit("unparseable").alias("status"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree) of bracketed trees in text files: each spans as many lines as its brackets stay open; an outer bracket without a label is taken off.

    A file is read whole, so a treebank comes in files of bounded size, as they are published.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"tree": [t for text in pdf["value"] for t in bracketed(text)]}, dtype="object")

    return spark.read.text(path, wholetext=True).mapInPandas(run, "tree string")


def bracketed(text: str) -> Iterator[str]:
    """The trees of a text, on one line each; what stands outside brackets, or in ones never closed, is left out."""
    depth, parts = 0, []
    for token in re.findall(r"\(|\)|[^\s()]+", text):
        if token == ")" and not depth or token not in "()" and not depth:
            continue
        depth += (token == "(") - (token == ")")
        parts.append(token)
        if not depth:
            if parts[1] == "(":  # ( (S ...) )
                parts = parts[1:-1]
            if parts[1:2] != [")"]:
                yield re.sub(r"\( ", "(", " ".join(parts)).replace(" )", ")")
            parts = []
