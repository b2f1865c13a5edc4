import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quaylark.llm import kdtree_topk, licenses, line_dedup, toxicity
from quaylark.llm.common import components, table
from quaylark.llm.hilbert_packing import encoder, hilbert, pack, tail_lengths, token_ids
from quaylark.llm.kdtree_topk import top_k
from quaylark.llm.line_dedup import duplicate_lines, without_duplicate_lines
from quaylark.llm.piecewise_hash import distances, edited, fingerprint, fingerprints, likeness
from quaylark.llm.quality import score_quality
from quaylark.llm.queries import op2_sentencepiece_sampling, op4_line_dedup
from quaylark.llm.sentencepiece_sampling import Model, decode, default_path, sample_segmentations, sample_texts
from quaylark.llm.signature_join import jaccard_components
from quaylark.llm.url_reputation import host_reputation, judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, host string, id string"
ODD = [None, "", "   ", "one", "a b c d e f g", "a b c d e f g", "A b c d e f g h\nsecond line here", "ß漢😀 x\n\n\ty  z", "word " * 30_000]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def near_copies(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split(" ")
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.randrange(3, 90))))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("texts", [near_copies(), near_copies(2, 120), ODD])
def test_jaccard(spark, texts):
    got = sorted(map(tuple, jaccard_components(docs(spark, texts)).select("id", "n_shingles", "component_id").collect()))
    roots, sizes = brute_components(texts)
    assert got == [(i, sizes[i], roots[i]) for i in range(len(texts))]


def test_jaccard_large_group(spark):
    """Copies of one text with an edit each: the blocks of many documents."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        w[r.randrange(60)] = f"x{r.randrange(1000)}"
        w[r.randrange(60)] = f"x{r.randrange(1000)}"
        texts.append(" ".join(w))
    got = {x["id"]: x["component_id"] for x in jaccard_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(150)] == brute_components(texts)[0]


def test_jaccard_repeated_and_null_ids(spark):
    got = jaccard_components(docs(spark, ["a b c d e f", "a b c d e f", "x y", "q"], [1, 1, 2, None])).collect()
    assert sorted((x["id"], x["component_id"]) for x in got) == [(1, 1), (2, 2)]
    assert jaccard_components(docs(spark, [])).count() == 0


def test_components(spark):
    e = [(5, 4), (4, 3), (3, 9), (20, 21), (22, 21), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20}


def brute_lines(texts):
    lines = [(i, k, frozenset(l.split(" ")) - {""}) for i, t in enumerate(texts) for k, l in enumerate((t or "").split("\n"))]
    out = set()
    for q, (i, k, s) in enumerate(lines):
        for _, _, r in lines[:q]:
            both = len(r & s)
            if r and s and 100 * both >= 90 * (len(r) + len(s) - both):
                out.add((i, k))
                break
    return out


@pytest.mark.parametrize("texts", [ODD, ["\n".join(near_copies(s, 12)) for s in range(12)] + ["\n".join(near_copies(3, 12))]])
def test_lines(spark, texts):
    df = docs(spark, texts)
    gone = brute_lines(texts)
    assert {(r["id"], r["line_no"]) for r in duplicate_lines(df).collect()} == gone
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in without_duplicate_lines(df).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        rest = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        if not any((i, k) in gone for k in range(len(lines))):
            assert kept[i][0] == t
        elif rest.strip():
            assert kept[i] == (rest, len(rest))
        else:
            assert i not in kept


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_lines_at(spark, percent):
    texts = ["\n".join(near_copies(s, 12)) for s in range(6)]
    lines = [(i, k, set(x.split())) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    want = {(i, k) for q, (i, k, s) in enumerate(lines) if any(100 * len(s & r) >= percent * len(s | r) for *_, r in lines[:q])}
    assert {(r["id"], r["line_no"]) for r in duplicate_lines(docs(spark, texts), percent=percent).collect()} == want


def test_lines_variants(spark):
    """Variants of a line that mostly match the base and not each other; long lines; empty table, null and repeated ids."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(90)]
    lines = []
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(90), 6):
            w[i] = f"x{r.randrange(10_000)}"
        lines.append(" ".join(w))
    texts = ["\n".join(lines[:30]), " ".join(base), "\n".join(lines[30:])]
    assert {(x["id"], x["line_no"]) for x in duplicate_lines(docs(spark, texts)).collect()} == brute_lines(texts)
    assert duplicate_lines(docs(spark, [])).count() == 0
    got = duplicate_lines(docs(spark, ["a b c", "a b c", "a b c", "d e"], [1, 1, None, 2])).collect()
    assert [(x["id"], x["line_no"]) for x in got] in ([], [(1, 0)])


def test_lines_white_space(spark):
    df = docs(spark, ["one two three\r\nfour five", "one\ttwo  three\nfour five\x0b\x0c", "one two\nfourfive", "\t\r\n \x0b"])
    assert {(r["id"], r["line_no"]) for r in duplicate_lines(df).collect()} == {(1, 0), (1, 1)}
    assert {r["doc_id"]: r["text"] for r in without_duplicate_lines(df).collect()} == {0: "one two three\r\nfour five", 2: "one two\nfourfive", 3: "\t\r\n \x0b"}


def test_lines_sets(spark, monkeypatch):
    """No lambda chooses per word, and white space is looked for in bytes; signatures bound the words that lines differ
    in, across LONG; a prefix begins with the rarest word."""
    plans = []
    monkeypatch.setattr(line_dedup, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    r = random.Random(7)
    every = [f"w{i}" for i in range(150)]
    texts = [" ".join(r.sample(every, n)) for n in (4, 5, 40, 60, 63, 64, 65, 66, 70, 90, 120, 150)]
    texts += [" ".join([*t.split()[1:], "\t\r", f"  new{i}"]) for i, t in enumerate(texts)]
    rows = {x["id"]: x for x in line_dedup._sets(docs(spark, texts).select(F.col("doc_id").alias("id"), line_dedup._spaced(F.col("text")).alias("text")), 80).collect()}
    words = [set(t.split()) for t in texts]
    assert [rows[i]["n"] for i in range(len(texts))] == [len(w) for w in words]
    assert all((rows[i]["more"] is not None) == (len(w) > line_dedup.LONG) for i, w in enumerate(words))
    for i, a in rows.items():
        for k, b in rows.items():
            apart = len(words[i] ^ words[k])
            if a["more"] is None or b["more"] is None:
                found = ((a["bits"] ^ (a["more"] or 0)) ^ (b["bits"] ^ (b["more"] or 0))) & (2**64 - 1)
                bound = found.bit_count()
            else:
                bound = sum(((a[c] ^ b[c]) & (2**64 - 1)).bit_count() for c in ("bits", "more"))
            assert bound <= apart and bound % 2 == apart % 2
    own = {x["h"]: x["w"] for x in spark.createDataFrame([(w,) for t in words for w in t], "w string").select("w", F.shiftrightunsigned(F.xxhash64("w"), 8).alias("h")).collect()}
    for i in range(len(texts) // 2, len(texts)):
        first = own[rows[i]["prefix"][0] & (2**56 - 1)]
        assert first.startswith("new") or sum(first in w for w in words) == 1
    (plan,) = plans
    assert not re.search(r"aggregate\(\w+#\d+, 0, lambdafunction\(if", plan) and not re.search(r"Contains\(text", plan)


def test_lines_in_production(spark, tmp_path):
    """One word of nine replaced, and one of eight."""
    nine, eight = "a b c d e f g h i", "q r s t u v w x"
    docs(spark, [f"{nine}\n{eight}", f"{nine[:-1]}z\n{eight[:-1]}z\nown"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["doc_id"], r["line_no"]) for r in op4_line_dedup(spark, str(tmp_path)).collect()] == [(1, 0)]
    kept = corpus_pipeline.line_dedup(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[1] == "q r s t u v w z\nown"


def test_licenses(spark):
    texts = ["Prose.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.", "er kommt mit der Bahn", None, "", "Licensed under the Foo Public License.", "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i]["license"] for i in range(6)] == ["MIT", "CC-BY-NC", None, None, None, "unknown"]
    assert got[6]["families"] == "Apache-2.0,GPL" and got[0]["paragraphs"] == 2 and got[3]["paragraphs"] == 0
    m = licenses.trained()
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            assert m["names"][int(licenses.probabilities(t, m).argmax())] == name


def brute_license(text, m):
    """(license, families, paragraphs) by plain Python."""
    found, count = [], 0
    for line in (text or "").split("\n"):
        if not line.strip(" \t\r\x0b\x0c"):
            continue
        count += 1
        words = licenses.tokens(line)
        if not set(words) & set(m["anchors"]):
            continue
        p = licenses.probabilities(line, m)
        if p[-1] >= 0.5:
            continue
        best = max(range(len(licenses.TEMPLATES)), key=lambda i: (p[i], m["names"][i]))
        pairs = lambda ws: {" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)}
        near = 0.0
        for t in licenses.TEMPLATES[m["names"][best]]:
            own = [g for g in licenses.grams(licenses.tokens(t)) if g.count(" ") == 1]
            near = max(near, len(pairs(words) & set(own)) / max(min(len(pairs(words)), len(own)), min(len(own), licenses.LEAST_PAIRS), 1))
        found.append((True, p[best], m["names"][best]) if p[best] >= m["bound"] and near >= 0.5 else (False, 1 - p[-1], licenses.UNKNOWN))
    return (max(found)[2] if found else None, ",".join(sorted({f[2] for f in found})), count)


def test_licenses_by_brute_force(spark):
    r = random.Random(6)
    words = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()})
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.OTHERS) + list(licenses.ORDINARY)
    texts = [*ODD, "x " * 40_000 + "\nReleased under the MIT License.", *notices]
    for _ in range(150):
        lines = [" ".join(r.choices(words, k=r.randrange(1, 25))) if r.random() < 0.4 else " ".join(w for w in r.choice(notices).split() if r.random() < 0.85) for _ in range(r.randrange(1, 4))]
        texts.append("\n".join(lines))
    m = licenses.trained()
    got = {x["doc_id"]: (x["license"], x["families"], x["paragraphs"]) for x in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {i: brute_license(t, m) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    assert [x["license"] for x in licenses.scan_licenses(docs(spark, ["Released under the MIT License."], [None])).collect()] == ["MIT"]


def test_licenses_held_out(spark):
    """Notices in wordings that the model has not seen."""
    held = {"MIT": "This project is distributed under the terms of the MIT License.", "Apache-2.0": "This library is licensed under the Apache License, Version 2.0, see the file for details.", "GPL": "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.", "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.", "CC-BY": "The text is licensed under a Creative Commons Attribution 4.0 International License."}
    plain = ["The general met the public at the gate.", "Der Mann geht in das Haus.", "La source de la rivière est libre.", "A new version of the old song was released."]
    rows = licenses.scan_licenses(docs(spark, [*held.values(), *plain])).collect()
    got = {x["doc_id"]: x["license"] for x in rows}
    assert [got[i] for i in range(len(held))] == list(held) and all(got[len(held) + i] is None for i in range(len(plain)))


def test_sampling_law():
    m, n = Model(default_path(), 0.15), 3000
    first, second, p = Counter(), Counter(), {}
    for s in range(n):
        a, b = sample_texts(["ab c"], [s], 2, m)[0]
        p[a[0].tobytes()] = math.exp(a[1])
        first[a[0].tobytes()] += 1
        second[b[0].tobytes()] += 1
    for k in p:
        assert abs(first[k] / n - p[k]) < 0.04
        assert abs(second[k] / n - sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)) < 0.04
    every = sample_texts(["ab c"], [1], 1000, m)[0]
    assert math.fsum(math.exp(x[1]) for x in every) == pytest.approx(1)
    assert len({x[0].tobytes() for x in every}) == len(every)


def test_sampling_bits(spark):
    """Equal rows give equal bits whatever stands beside them."""
    r = random.Random(3)
    texts = [" ".join(near_copies(i, 5)) for i in range(20)]
    m = Model(default_path(), 1.0)
    whole = sample_texts(texts, list(range(20)), 2, m)
    order = r.sample(range(20), 20)
    m = Model(default_path(), 1.0)
    for i in order:
        alone = sample_texts([texts[i]], [i], 2, m)[0]
        assert [(x.tobytes(), p, q) for x, p, q in alone] == [(x.tobytes(), p, q) for x, p, q in whole[i]]
    assert decode(sample_segmentations(docs(spark, ["a\u2581b", None], [None, None]), k=1)).select("text").distinct().count() == 2
    assert sample_segmentations(docs(spark, [])).count() == 0


def test_sampling_round_trip(spark):
    df = docs(spark, ODD)
    out = decode(sample_segmentations(df, k=3)).collect()
    for r in out:
        assert r["text"] == (ODD[r["doc_id"]] or "")
    assert len({(r["doc_id"], bytes(r["ids"])) for r in out}) == len(out)
    again = {(r["doc_id"], r["sample"]): bytes(r["ids"]) for r in sample_segmentations(df.repartition(3), k=3).collect()}
    assert again == {(r["doc_id"], r["sample"]): bytes(r["ids"]) for r in out}


def test_sampling_compares(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op2_sentencepiece_sampling(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(ODD))) and all(r["round_trip"] for r in rows)
    crcs = sample_segmentations(docs(spark, ODD), crc=True).collect()
    assert all(r["text_crc32"] == zlib.crc32((ODD[r["doc_id"]] or "").encode()) for r in crcs)


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/a?x", "http://example.com/en/", "https://shop.com", "https://a.net/es/1", None, "no scheme", "http://good.org/x#y", "http://bad.org/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/x", "", "") for i in range(60)] + [(200 + i, f"http://ok{i}.org/x", "", "") for i in range(90)], "page_id long, url string, html string, rule string")
    outcomes = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(90)] + [(6, 1)], "doc_id long, good int")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, outcomes, rules).collect()}
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2] == ("shop.com", "", None, "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6] == ("good.org", "/x", None, "allow") and got[7][3] == "block"
    assert judge_urls(pages.limit(0), outcomes, rules).count() == 0


def test_urls_back_off(spark):
    """Hosts without labels: of a bad domain, of a good one, of a bad suffix, of a new one, and no host."""
    rate = {"bad": 1, **{f"ok{d}": 16 for d in range(19)}}
    known = [(f"h{h}.{d}.com", int(i < good)) for d, good in rate.items() for h in range(10) for i in range(20)]
    known += [(f"h{h}.b{d}.zip", 0) for d in range(20) for h in range(5) for _ in range(20)]
    new = ["new.bad.com", "new.ok1.com", "x.new.com", "x.new.zip", "x.new.dev", ""]
    urls = [f"http://{h}/x" for h, _ in known] + [f"http://{h}/x" if h else "none" for h in new]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(known)], "doc_id long, good int")
    got = {r["host"]: r for r in judge_urls(pages, outcomes, []).collect()}
    assert [got[h]["verdict"] for h in new] == ["block", "allow", "allow", "block", "allow", "allow"]

    def weight(groups):
        """groups: (n, good, parent's mean)."""
        s = sum((g / n - p) ** 2 * n for n, g, p in groups)
        noise, more = sum(p * (1 - p) for _, _, p in groups), sum(p * (1 - p) * (n - 1) for n, _, p in groups)
        return min(max(more / (s - noise) - 1, 1.0), 1000.0) if s > noise else 1000.0

    overall = (sum(g for _, g in known) + 1) / (len(known) + 2)
    suffixes, domains = {}, {}
    for host, g in known:
        for level, key in ((suffixes, host.split(".")[-1]), (domains, host.split(".", 1)[1])):
            n, good = level.get(key, (0, 0))
            level[key] = (n + 1, good + g)
    w = weight([(n, g, overall) for n, g in suffixes.values()])
    suffixes = {k: (g + w * overall) / (n + w) for k, (n, g) in suffixes.items()}
    w = weight([(n, g, suffixes[k.split(".")[-1]]) for k, (n, g) in domains.items()])
    domains = {k: (g + w * suffixes[k.split(".")[-1]]) / (n + w) for k, (n, g) in domains.items()}
    want = [domains["bad.com"], domains["ok1.com"], suffixes["com"], suffixes["zip"], overall, overall]
    assert [got[h]["reputation"] for h in new] == pytest.approx(want)


def test_suffixes(spark):
    """Listed, private, wildcard, exception, other alphabet, unlisted, and hosts that are suffixes."""
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.co.nz": ("y.co.nz", "co.nz"), "me.com.mx": ("me.com.mx", "com.mx"), "www.me.github.io": ("me.github.io", "github.io"), "www.example.com": ("example.com", "com"), "a.b.foo.ck": ("b.foo.ck", "foo.ck"), "a.www.ck": ("www.ck", "ck"), "a.b.xn--p1ai": ("b.xn--p1ai", "xn--p1ai"), "a.b.unlisted": ("b.unlisted", "unlisted"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost")}
    found, _ = host_reputation(spark.createDataFrame([(h, 1) for h in want], "host string, good int"))
    assert {r["host"]: (r["domain"], r["suffix"]) for r in found.collect()} == want


def test_quality(spark):
    r = random.Random(3)
    good = [" ".join(r.choices("abc defg hij klmno pq rst uvw".split(), k=40)) + "." for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in r.choices("abc defg hij".split(), k=40)) for _ in range(60)]
    df = docs(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = {x["doc_id"]: x["good"] for x in score_quality(df, labels).collect()}
    assert len(got) == 122 and sum(got[i] == (i < 60) for i in range(120)) == 120
    assert {x["score"] for x in score_quality(df, labels.limit(0)).collect()} and score_quality(df.limit(0), labels).count() == 0


def test_quality_sites(spark):
    """Site means by plain sums: no row sees its own label or evidence, priors are fitted by moments."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("abc defg HIJ! klmno".split(), k=r.randrange(3, 30))), f"p{i % 3}", f"h{i % 4 if i < 180 else 9}", r.random() < (0.9 if i % 4 else 0.2)) for i in range(200)]
    df = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")
    labels = {i: int(y) for i, *_, y in rows if i % 2}
    got = {x["doc_id"]: x for x in score_quality(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    own = {i: (1.0, float(labels[i])) if i in labels else (0.2, 0.2 * got[i]["evidence"]) for i, *_ in rows}
    paths, hosts = {}, {}
    for i, _, path, host, _ in rows:
        for d, k in ((paths, (host, path)), (hosts, host)):
            n, s = d.get(k, (0.0, 0.0))
            d[k] = (n + own[i][0], s + own[i][1])
    overall = (sum(s for _, s in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)

    def weight(groups):
        groups = [(n, s, p) for n, s, p in groups if n >= 2]
        more = sum(p * (1 - p) * (n - 1) for n, _, p in groups)
        rho = (sum((s / n - p) ** 2 * n for n, s, p in groups) - sum(p * (1 - p) for *_, p in groups)) / more
        return min(max(1 / rho - 1 if rho > 0 else 1000.0, 1.0), 1000.0)

    w1 = weight([(n, s, overall) for n, s in hosts.values()])
    w2 = weight([(n, s, (hosts[h][1] + w1 * overall) / (hosts[h][0] + w1)) for (h, _), (n, s) in paths.items()])
    for i, _, path, host, _ in rows:
        (n, s), (hn, hs), (a, b) = paths[host, path], hosts[host], own[i]
        mean = (hs - b + w1 * overall) / (hn - a + w1)
        assert got[i]["site_mean"] == pytest.approx((s - b + w2 * mean) / (n - a + w2))


def toxic_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(30)) + "." for _ in range(300)]
    toxic = [int(i % 4 == 0) for i in range(300)]
    return [t if not y else t[:40] + " you zorg, " + t[40:] for t, y in zip(texts, toxic, strict=True)], toxic


def marks(spark, toxic):
    return spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")


def test_composed_machine():
    """The composed table against the five machines one after the other, and against all arcs of each by hand."""
    weights = {e: 1 + i / 7 for i, e in enumerate(toxicity.EVENTS)}
    whole = toxicity.composed(weights)
    r = random.Random(1)
    short = [list(x) for n in range(4) for x in itertools.product(toxicity.SYMBOLS, repeat=n)]
    for symbols in short + [r.choices(toxicity.SYMBOLS, k=r.randrange(4, 30)) for _ in range(2000)]:
        out, total = symbols, 0.0
        for m in toxicity.machines(weights):
            out, w = m.run(out)
            total += w
        got, weight = whole.run(symbols)
        assert got == out and weight == pytest.approx(total)
        # the same by the scopes themselves
        said = quoted = False
        want, threat = [], None
        for i, s in enumerate(symbols):
            said, quoted = said or s == "report", quoted != (s == "quote")
            # a scope is of so many tokens since its last opener
            back = lambda x, n: x in symbols[max(0, i - n) : i]  # noqa: E731, B023
            if s in toxicity.INSULTS or s == "threat":
                marked = s + "|n" * back("negation", 3) + "|r" * (said and quoted) + ("|t" * back("target", 4) if s != "threat" else "")
                if s == "threat":
                    threat = (i, marked.removeprefix("threat"))
                want.append(marked)
            elif s == "target" and threat and i - threat[0] <= 3:
                want.append("attack" + threat[1])
                threat = None
            else:
                want.append(s)
        # an attack takes its target, which then opens no scope for the machines after it, but the target machine is before
        assert got == want


def test_toxicity(spark):
    texts, toxic = toxic_texts()
    g = toxicity.train(docs(spark, texts), marks(spark, toxic))
    assert "zorg" in g.words
    scored = lambda t: toxicity.clause_score([g.number(w) for w in t.split()], g)
    assert scored("you are a zorg") > scored("you are not a zorg") > 0 == scored("you are fine")
    out = {x["doc_id"]: x for x in toxicity.score_toxicity(docs(spark, ["you zorg", "fine", None, "", "word " * 30_000]), g).collect()}
    assert [out[i]["predicted"] for i in range(5)] == [1, 0, 0, 0, 0] and all(0 <= x["score"] <= 1 for x in out.values())
    assert {x["doc_id"] for x in toxicity.without_toxic(docs(spark, ["you zorg", "fine", None, ""]), g).collect()} == {1, 2, 3}
    new = docs(spark, texts[:40], [*range(38), None, 0])
    assert sorted(x["score"] for x in toxicity.score_toxicity(new, g).collect()) == pytest.approx(sorted(toxicity.score(t, g) for t in texts[:40]))
    assert toxicity.score_toxicity(new.limit(0), g).count() == 0


def test_toxicity_learns_from_bounded_rows(spark, monkeypatch):
    """Rows count, not ids; one label alone teaches nothing; the lexicon is that of plain counts."""
    texts, toxic = toxic_texts()
    many = docs(spark, [*texts, *[texts[0]] * 500], [*range(300), *[0] * 500])
    seen = []
    monkeypatch.setattr(toxicity, "released", lambda *t: seen.append(t[0].count()))
    toxicity.train(many, marks(spark, toxic), rows=100)
    assert max(x for x in seen if x <= 300) <= 100
    assert toxicity.train(docs(spark, texts), marks(spark, [0] * 300)).words == {}
    yes, no = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (yes if y else no).update({w for kind, w in toxicity.terms(t) if kind == "word"})
    share = math.log((sum(toxic) + 1) / (300 - sum(toxic) + 1))
    want = {}
    for w, n in yes.items():
        z = math.log((n + 0.3) / (no[w] + 0.3)) - share
        if n >= 3 and z - 2 * math.sqrt(1 / (n + 0.3) + (1 / (no[w] + 0.3) if no[w] else 1)) > 0.7 and w not in toxicity.TARGET:
            want[w] = z
    assert toxicity.train(docs(spark, texts), marks(spark, toxic)).words == pytest.approx(want)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = [(int(i), rng.normal(0, 0.2, 5).astype(np.float32).tolist(), 1) for i in range(900)]
    x[7] = (7, x[8][1], 1)
    odd = [(1000, None, 1), (1100, [1.0, None, 0.0, 0.0, 0.0], 1), (1200, [float("nan")] * 5, 1), (1300, [1.0, 2.0], 1), (1400, [2.0, 1.0], 1), (None, [0.1] * 5, 1)]
    got = Counter()
    rows = top_k(spark.createDataFrame(x + odd, "vec_id long, embedding array<float>, score int"), every=100).collect()
    v = {i: np.floor(1024 * np.array(a, np.float32).astype(float)).astype(int) for i, a, _ in x}
    for q in range(0, 900, 100):
        want = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
        got[q] += 1
    assert sorted((r["query_id"], r["vec_id"]) for r in rows if r["query_id"] >= 900) == [(1300, 1400), (1400, 1300)]


def test_top_k_large_components(spark):
    """Components of 2^40 and more take part; products beyond int64 cancel; too large ones are errors."""
    big = 2.0**41
    x = [(0, [big, -big]), (1, [big, big]), (2, [1.0, 2.0]), (3, [0.0, -1.0]), (4, [float("inf"), 0.0])]
    x += [(5 + i, [big, big - i / 1024]) for i in range(200)]
    v = {i: [math.floor(1024 * y) for y in a] for i, a in x if i != 4}
    want = sorted((-(v[0][0] * v[i][0] + v[0][1] * v[i][1]), i) for i in v if i != 0)
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    want = [(n + 1, i, -s) for n, (s, i) in enumerate(want[:10])]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in top_k(df, every=1000).orderBy("rank").collect()] == want
    with pytest.raises(Exception, match="no long"):
        top_k(spark.createDataFrame([(0, [1e30])], df.schema)).collect()


def test_top_k_shards(spark, monkeypatch):
    """Many shards and cells, ties, repeated ids and components from 2^10 to 2^28, against brute force."""
    monkeypatch.setattr(kdtree_topk, "SHARD", 40)
    monkeypatch.setattr(kdtree_topk, "SHARDS", 6)
    rng = np.random.default_rng(1)
    x = [(int(i), (rng.integers(-3, 4, 3) * 2.0 ** rng.choice([0, 10, 18])).tolist()) for i in range(500)]
    x += [(100, [2.0**20, 0.0, 1.0]), (100, [2.0**20, 0.0, 1.0]), (7, x[3][1]), (7, x[3][1])]
    v = [(i, [math.floor(1024 * y) for y in a]) for i, a in x]
    want = []
    for r, (q, a) in enumerate(v):
        if q % 100 == 0:
            best = sorted((-sum(s * t for s, t in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(v) if n != r)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    rows = top_k(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_fingerprints(spark):
    texts = [*ODD, " ".join(near_copies(9, 40))]
    got = {r["doc_id"]: r for r in fingerprints(docs(spark, texts), rows_in_bucket=3).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        after = full[(i + 1) % len(full)]
        new = edited(t, after)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (fingerprint(t), fingerprint(new))
        assert got[i]["near_next"] == pytest.approx(likeness([fingerprint(t)], [fingerprint(after)])[0])
    assert fingerprints(docs(spark, [])).count() == 0 and fingerprints(docs(spark, ["x y"])).first()["near_next"] == 1


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    r = random.Random(2)
    pairs = [("".join(r.choices("AB+/", k=r.randrange(65))), "".join(r.choices("AB+/", k=r.randrange(65)))) for _ in range(200)]
    assert distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "a<|endoftext|>b", "x\n\n\n  y"]
    for x in texts:
        assert token_ids(x, encoder()).tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]
    rows = pack(docs(spark, texts), size=64).collect()
    back = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == len(back.setdefault(r["doc_id"], []))
        back[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert all(back[i] == token_ids(x, encoder()).tolist() for i, x in enumerate(texts))
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 64 and n & (n - 1) == 0 for n in sequences.values())
    assert pack(docs(spark, [])).count() == 0 and tail_lengths(13) == [8, 4, 1]


def test_hilbert():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    h = hilbert(cells, 3)
    assert sorted(h.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_levels_come_shifted(spark):
    texts = spark.createDataFrame([(1, "a a a a\nb"), (2, "a")], "id long, text string")
    got = spark.range(1).select(line_dedup._levels(texts).alias("x")).first()[0]
    # five of one word, one of another; log2(5) * 3 is 6.97; buckets without a word have the last level
    assert Counter(got) == {0: 1, 6 << 56: 1, 127 << 56: line_dedup.BUCKETS - 2}
