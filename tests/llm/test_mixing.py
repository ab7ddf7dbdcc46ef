"""Hierarchical budgets against plain water filling, and prefixes against a plain walk."""

import hashlib
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from boxloom.llm.mixing import mix


def deal(children, budget):
    """children: name -> (cap, weight)."""
    order = sorted(children, key=lambda k: (children[k][0] / children[k][1], k))
    share, left, weight = {}, budget, sum(w for _, w in children.values())
    for k in order:
        cap, w = children[k]
        if cap * weight <= left * w:
            share[k], left, weight = cap, left - cap, weight - w
        else:
            break
    rest = [k for k in children if k not in share]
    for k in rest:
        share[k] = int(Fraction(left * children[k][1], weight))
    spare = left - sum(share[k] for k in rest)
    for k in sorted(rest)[:spare]:
        share[k] += 1
    return share


def test_against_plain(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), f"src{min(r.randint(0, 9), r.randint(0, 9))}") for i in range(300)]
    rows += [(900, None, "en", "src0"), (901, "", "xx", "empty"), (None, "a b c", "en", "src1"), (5, rows[5][1], *rows[5][2:])]
    weights = {"domain": {"d0": 5}, "lang": {"en": 3, "de": 2}, "source": {"src1": 7}}
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, lang string, source string, tokens int, budget int")
    domain = lambda s: "d" + str(int(s[3:]) % 2) if s.startswith("src") else "none"
    column = F.when(F.col("source").startswith("src"), F.concat(F.lit("d"), (F.substring("source", 4, 9).cast("int") % 2).cast("string"))).otherwise("none")
    for part, epochs in (((1, 2), 1), ((3, 4), 2), ((3, 1), 2), ((1, 1), 1)):
        got = mix(df, [column, F.col("lang"), F.col("source")], weights, part, epochs, 9).collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        leaf = lambda x: (domain(x[3]), x[2] or "", x[3] or "")
        tokens = {}
        for x in rows:
            tokens[leaf(x)] = tokens.get(leaf(x), 0) + size(x[1])
        budget = {(): min(sum(tokens.values()) * part[0] // part[1], sum(tokens.values()) * epochs)}
        for depth, level in enumerate(("domain", "lang", "source")):
            groups = {}
            for k, n in tokens.items():
                groups.setdefault(k[:depth], {}).setdefault(k[depth], [0, weights[level].get(k[depth], 1)])[0] += n * epochs
            for parent, children in groups.items():
                for name, share in deal({k: tuple(v) for k, v in children.items()}, budget[parent]).items():
                    budget[(*parent, name)] = share
        want = []
        for k, n in tokens.items():
            whole, rest = divmod(budget[k], max(n, 1))
            own = sorted((x for x in rows if leaf(x) == k), key=lambda x: (hashlib.md5(f"9:{whole}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), size(x[1])))
            for x in own:
                used = max(0, min(size(x[1]), rest))
                rest -= used
                want.append((x[0], *k, size(x[1]), whole, used, whole * size(x[1]) + used))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert sum(x.taken_tokens for x in got) == budget[()]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mix(df, [F.lit("d"), F.col("lang"), F.col("source")], {}).collect() == []
