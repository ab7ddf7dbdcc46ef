"""SimHash links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from boxloom.llm import simhash


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    n = len(prints)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("group", [2, 4, 256])
def test_links_find_every_component(spark, group):
    r = random.Random(group)
    prints = []
    for _ in range(40):
        base = r.getrandbits(64)
        prints.append(base)
        for _ in range(r.randint(0, 6)):
            for b in r.sample(range(64), r.randint(1, 4)):
                base ^= 1 << b
            prints.append(base)
    prints = sorted(set(prints))
    r.shuffle(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = simhash.links(df, group=group).collect()
    for x in found:
        assert ((x.a ^ x.b) & ((1 << 64) - 1)).bit_count() <= 3
    got = {x.node: x.component_id for x in simhash.components(simhash.links(df, group=group)).collect()}
    want = plain_components(prints)
    by_got, by_want = {}, {}
    for i, p in enumerate(prints):
        by_got.setdefault(got.get(signed(p), signed(p)), set()).add(p)
        by_want.setdefault(want[i], set()).add(p)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_documents(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [(5, "A b c d e f"), (3, "a B  c\td e f"), (9, None), (4, ""), (8, " \n"), (7, "one"), (6, "ONE"), (2, long), (1, long + " more"), (None, "one"), (7, "one"), (11, "été Été")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, fp string, label int")
    got = [(x.doc_id, x.fingerprint, x.component_id) for x in simhash.simhash_dedup(df).collect()]
    prints = [plain_fingerprint(t) for _, t in texts]
    label = plain_components(prints)
    want = [(i, f"{prints[k]:016x}", min(texts[j][0] for j in range(len(texts)) if label[j] == label[k] and texts[j][0] is not None)) for k, (i, _) in enumerate(texts)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(df).collect() == []


def test_group_has_a_bound():
    """One join of a dense group links all that is near, with fewer links than members."""
    fps = np.arange(2048, dtype=np.int64)
    a, _ = simhash.join_group(fps, 3)
    assert len(a) == 2047
