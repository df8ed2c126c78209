"""The whole pipeline against a plain one: every stage's decisions on a fixture that shows them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratagraph.llm.common import find_package

WORDS = "river stone cloud meadow lantern harbour copper willow signal garden bridge winter orchard kettle marble canyon feather anchor timber valley".split()


def fixture():
    """(documents, labels, benchmark, ids of good documents)"""
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(WORDS[rng.integers(20)] + WORDS[rng.integers(20)][: rng.integers(2, 6)] for _ in range(n))
    prose = lambda: ". ".join(say(int(rng.integers(8, 14))).capitalize() for _ in range(6)) + "."
    junk = lambda: "$$$ ".join(["BUY!!!", "###", "@@ 9999"][rng.integers(3)] for _ in range(60))
    item = say(20)
    rows, good = [], []
    for i in range(240):
        if i % 3 == 2:
            rows.append((i, junk(), "en", "web"))
            continue
        good.append(i)
        text = prose()
        if i % 20 == 4:  # near and exact copies of the good one before
            text = rows[good[-2]][1] + (" End." if i % 40 == 4 else "")
        if i % 20 == 6:  # a benchmark passage
            text = text[:200] + " " + item + " " + text[200:400]
        rows.append((i, text, "en", "books" if i % 12 == 0 else "web"))
    rows += [rows[0], (None, prose(), None, None)]  # a repeated row; one without an id
    labels = [(i, int(i in set(good)), 0) for i in range(240) if i % 7 != 5]
    return [(*r, len(r[1])) for r in rows], labels, [("b1", item), ("b2", None)], set(good)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_groups(rows):
    """Of rows (id, text): the smallest id of each row's group."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and of[a] != of[b]:
                of = [of[b] if x == of[a] else x for x in of]
    return [min(rows[k][0] for k in range(len(rows)) if of[k] == of[n]) for n in range(len(rows))]


def copies(rows, power=0.5):
    """How often each row (id, source) is repeated: Poisson distributions inverted one by one."""
    n = Counter(s for _, s in rows)
    total = sum(x**power for x in n.values())
    out = []
    for i, s in rows:
        rate = len(rows) * n[s] ** power / total / n[s]
        u = int(hashlib.md5(f"17|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        out.append(k)
    return out


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    find_package(spark)
    docs, labels, benchmark, good = fixture()
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    kept = [d for d in docs if d[0] is None or d[0] in good]
    first = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in first.collect() if r.doc_id is not None) == sorted(d[0] for d in kept if d[0] is not None)

    named = list({d[0]: d for d in kept if d[0] is not None}.values())
    least = near_groups([(d[0], d[1]) for d in named])
    kept = [d for d, m in zip(named, least) if d[0] == m] + [d for d in kept if d[0] is None]
    assert len(named) - len(kept) >= 5
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    item = words(benchmark[0][1])
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    clean = [d for d in kept if not any(tuple(words(d[1])[k : k + 13]) in windows for k in range(len(words(d[1]))))]
    assert len(kept) - len(clean) >= 5
    mixed = [d for d, n in zip(clean, copies([(d[0], d[3]) for d in clean])) for _ in range(n)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(d[1], add_special_tokens=False).ids + [0] for d in mixed]
    want = sorted(((d[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in zip(mixed, ids)), key=str)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert order != sorted(order)  # records keep the mixed order
