"""Operators over whole tables against brute force on small fixtures."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casegrid.llm import chat_rotation, cotraining, decontaminate, jaccard_join, licence_scan, line_dedup, near_groups, warc
from casegrid.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    words = WORD.findall(lower(text))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] or ([tuple(words)] if words else [])


# --- Jaccard join


def components(rows):
    sets = [(d, frozenset(shingles(t))) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d) if s else d) for d, s in sets)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not out:
            out.insert(k, f"e{rng.randrange(1000)}")
        elif kind == 1:
            out[min(k, len(out) - 1)] = f"e{rng.randrange(1000)}"
        else:
            del out[min(k, len(out) - 1)]
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for _ in range(12):  # chains of edits of one text
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 12, 30, 120, 400]))]
        for _ in range(rng.randrange(2, 8)):
            words = edited(rng, words, rng.randrange(0, 3))
            rows.append(" ".join(words))
    base = [f"h{i}" for i in range(150)]
    rows += [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(60)]  # one large group
    rows += [" ".join(passage + [f"u{rng.randrange(9999)}" for _ in range(rng.randrange(5, 100))]) for _ in range(60)]  # a passage in common
    for n in range(1, 22):  # small sets
        words = [f"s{i}" for i in range(n)]
        rows += [" ".join(words), " ".join(words + ["x"]), " ".join(["y"] + words[1:]), " ".join(words).upper() + " \n"]
    rows += ["", None, " \n\t", "é É", "é É "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed) + [(3, "another text of row three that is long enough to be a set of its own here"), (None, corpus(seed)[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).selectExpr("*", "1 as n", "'k' as key", "2 as sid", "0 as component")
    got = jaccard_join.jaccard_components(df).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == components(rows)
    assert [(r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is None] == [(None, len(set(shingles(rows[-1][1]))))]


def test_large_sets_with_a_passage_in_common_meet_pair_by_pair(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"u{rng.randrange(10**9)}" for _ in range(900)] for _ in range(10)]
    texts += [edited(rng, texts[0], 3), edited(rng, texts[1], 20)]
    rows = list(enumerate(map(" ".join, texts)))
    monkeypatch.setattr(near_groups, "_differences", lambda *_: pytest.fail("members of large sets that share a passage were compared"))
    # A row in each task, so that no shingle is known to be frequent.
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect()) == components(rows)


def test_differences_carry_the_values_of_their_sets(spark):
    sets = [(1, 7, 3, 5, [10, 20, 30]), (2, 7, 2, 6, [10, 40]), (3, 7, 2, 6, [10, 20])]
    rows = [(sid, group, n, component, b"".join(e.to_bytes(8, "little") for e in held)) for sid, group, n, component, held in sets]
    grouped = spark.createDataFrame(rows, "sid bigint, `group` bigint, n int, component bigint, members binary")
    consensus = spark.createDataFrame([(7, [10, 20])], "`group` bigint, consensus array<bigint>")
    got = near_groups._differences(grouped, consensus).select("sid", "group", "n", "component", "element", "d").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 7, 3, 5, 30, 1), (2, 7, 2, 6, 20, 2), (2, 7, 2, 6, 40, 2), (3, 7, 2, 6, None, 0)]


def test_jaccard_empty_table_and_first_rows(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "a b c d e f"), (2, "A b  c d e f"), (3, "x"), (4, ""), (None, "a b c d e f"), (5, None)]
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]


def test_intermediate_rows_are_in_few_files(spark, monkeypatch, tmp_path):
    for module in (jaccard_join, line_dedup):
        monkeypatch.setattr(module, "scratch_path", lambda _, name: str(tmp_path / name))
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(40)
    # Lines of one text that meet within one edit, so that every step has rows.
    lines = spark.createDataFrame([(i, f"a line that is there again {i // 2} {'x' * (i % 2)}\n" * 2) for i in range(80)], "doc_id int, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = [(r[0], r[2]) for r in jaccard_join.jaccard_components(docs).collect()]
        line_dedup.deduplicate_lines(lines.repartition(40)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(found, key=repr) == sorted(((d, c) for d, _, c in components(rows)), key=repr)
    steps = {p.parent for p in tmp_path.rglob("part-*")}
    assert {"stats", "lists", "sets", "keys-0", "rows-0"} <= {p.name for p in steps}
    most = 2 * spark.sparkContext.defaultParallelism
    assert {p.name: n for p in steps if (n := len(list(p.glob("part-*")))) > most} == {}
    assert not list(tmp_path.rglob("_SUCCESS"))


def test_boundary_goes_by_cost():
    assert jaccard_join.boundary({n: 1000 for n in range(1, 30)}, 1000.0) > jaccard_join.boundary({n: 1000 for n in range(1, 30)}, 0.0)
    for n in range(1, 17):
        for m in range(n, 17):
            if 4 * m <= 5 * n and n != m:
                c = jaccard_join.required(n, m)
                assert c > n or (c in jaccard_join.subset_sizes(n, 16) and c in jaccard_join.subset_sizes(m, 16))


# --- Lines


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b


def plain_lines(rows, least):
    lines = [(d is None, d or 0, k, line.strip(" ")) for d, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[3]) >= least)
    first = {}
    for *place, line in lines:
        first.setdefault(line, place)
    near = {a for a in first for b in first if first[b] < first[a] and distance_at_most_one(a, b)}
    gone = {(p, k) for n, p, k, line in lines if [n, p, k] != first[line] or line in near}
    return sorted(((d or 0), "\n".join(x for k, x in enumerate(t.split("\n")) if (d or 0, k) not in gone) if t is not None else None) for d, t in rows)


def test_line_dedup(spark):
    rng = random.Random(7)
    alphabet = "abé "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    for line in list(pool):
        for _ in range(2):
            k = rng.randrange(len(line))
            pool.append(line[:k] + rng.choice(["", "z", line[k] + "b", "é"]) + line[k + 1 :])
    rows = [(i + 1, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n"), (None, pool[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr("*", "1 as no", "'q' as line", "2 as h", "3 as drops")
    got = line_dedup.deduplicate_lines(df, min_chars=4)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got.collect()) == plain_lines(rows, 4)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.deduplicate_lines(empty).count() == 0


def test_line_dedup_of_long_lines(spark):
    rng = random.Random(9)
    rows, k = [], 0
    for n in (20, 63, 64, 65, 66, 255, 256, 257, 258, 300, 1030, 5000):
        line = "".join(rng.choice("abcdé ") for _ in range(n - 2))
        line = f"x{line}x"
        for at in (0, n // 3, n // 2, n - 1):
            for edit in (line[:at] + line[at + 1 :], line[:at] + "Z" + line[at:], line[:at] + "Y" + line[at + 1 :]):
                rows.append((k, edit))
                k += 1
        rows.append((k, line))
        k += 1
    rng.shuffle(rows)
    got = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain_lines(rows, 20)


def test_line_dedup_spares_short_lines_and_equal_rows(spark):
    text = "short\nshort\n" + "x" * 30
    rows = [(1, text), (1, text), (2, "y" + "x" * 29 + "\nshort")]
    got = sorted(map(tuple, line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True).collect()))
    assert got == [(1, text, 3, 0), (1, text, 3, 0), (2, "short", 2, 1)]


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_KEYS", 0)
    rows = [(k, f"the same line in every document\nline {k} of its own kind\n") for k in range(12)]
    got = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True)
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {0: 0} | {k: 2 for k in range(1, 12)}


# --- Benchmark passages


def test_find_passages(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 15, 40, 90])))) for i in range(40)]
    items += [(40, "la la la la la la la la la la la"), (41, None), (42, ""), (None, "no id of its own"), (43, items[6][1])]
    rows = []
    for k in range(120):
        words = [f"d{rng.randrange(500)}" for _ in range(rng.randrange(0, 60))]
        if k % 2:
            own = WORD.findall(rng.choice(items)[1] or "la la la")
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, own, rng.randrange(0, 3))
        rows.append((k, (" ".join(words).upper() if k % 7 == 0 else "\n".join(words))))
    rows += [(5, "la " * 30), (200, None), (None, items[7][1])]

    def expected():
        out = {}
        for d, text in rows:
            for i, item in items:
                words = WORD.findall(lower(item))
                if i is None or not words:
                    continue
                n = min(5, len(words))
                mine, theirs = Counter(shingles(item, n)), shingles(text, n) if len(WORD.findall(lower(text))) >= n else []
                size = sum(mine.values())
                for a in range(max(1, len(theirs) - size + 1)):
                    w = Counter(theirs[a : a + size])
                    shared = sum((w & mine).values())
                    total = sum(w.values()) + size - shared
                    if shared and 100 * shared >= 80 * total:
                        old = out.get((d, i, text), (0, 0, 0, 0))
                        best = max(old[:3], (shared / total, -a, shared))
                        out[d, i, text] = (*best, old[3] + 1)
        return sorted((str(d), i, round(v[0], 9), v[2], -v[1], v[3]) for (d, i, _), v in out.items())

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as similarity")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'u' as doc_id")
    for chars in (4_000_000, 700):  # one pass and several
        monkeypatch.setattr(decontaminate, "PASS_CHARS", chars)
        got = decontaminate.find_passages(docs, bench).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 9), r["shared"], r["start_word"], r["n_windows"]) for r in got) == expected()
    gone = {r["doc_id"] for r in got}
    assert decontaminate.remove_contaminated(docs, bench).where("doc_id is not null").select("doc_id").distinct().count() == len({d for d, _ in rows} - gone - {None})
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0


def test_blocks_find_every_print_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    items = decontaminate.Items(9, list(range(50)), [rng.integers(0, 1 << 60, 5).astype(np.uint64) for _ in range(50)])
    flips = np.zeros((500, 64), np.uint8)
    for row in flips:
        row[rng.choice(64, decontaminate.RADIUS, replace=False)] = 1
    own = rng.integers(0, 50, 500)
    prints = items.prints[own] ^ np.packbits(flips, axis=1)
    assert set(enumerate(own)) <= set(zip(*(a.tolist() for a in items.candidates(prints))))


# --- WARC


def test_warc_revisits(spark):
    page, other = "<p>" + "x" * 120, "é\r\n\r\n" * 60
    rows = [(5, "http://a\r\nb", page), (3, "u", page), (3, "u", page), (9, None, "short"), (10, "u", "short"), (None, "n", page), (11, "u", None), (12, "é", other), (13, "é", other)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).selectExpr("*", "1 as record_id", "2 as member")
    a, b, c = (scratch_path(spark, "test-warc") for _ in range(3))
    warc.write_pages(df, a)
    warc.deduplicate(spark, a, b)
    key = lambda r: str(tuple(r))
    got = sorted(warc.resolved_pages(spark, b).select("page_id", "payload_bytes", "record_type", "refers_to").collect(), key=key)
    expected = [(5, 123, "revisit", 3), (3, 123, "response", None), (3, 123, "revisit", 3), (None, 123, "revisit", 3), (9, 5, "response", None),
                (10, 5, "response", None), (11, 0, "response", None), (12, 480 - 60, "response", None), (13, 480 - 60, "revisit", 12)]
    assert [tuple(r) for r in got] == sorted([(p, n if p not in (12, 13) else len(other.encode()), t, r) for p, n, t, r in expected], key=str)
    # Archives that hold revisits already come out the same.
    warc.deduplicate(spark, b, c)
    again = warc.resolved_pages(spark, c).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(again, key=key) == got


def test_warc_records_are_gzip_members(spark):
    import glob
    import gzip

    path = scratch_path(spark, "test-warc")
    warc.write_pages(spark.createDataFrame([(1, "http://x", "hello")], "page_id bigint, url string, html string").coalesce(1), path)
    (name,) = glob.glob(f"{path.removeprefix('file:')}/part-*")
    data = gzip.open(name).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nhello\r\n\r\n")
    plain = list(warc._members(memoryview(data)))
    assert [warc._parse(whole)[1] for whole, _ in plain] == [b"hello"]
    empty = scratch_path(spark, "test-warc")
    warc.write_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


# --- Dialogues


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann Lee", "Hi <|im_end|>"), (1, 2, "bob", "Hé"), (1, 2, "bob", "Hé"), (1, 64, "Ann Lee", None),
        (2, 0, "system", "alone"), (3, None, None, "who"), (3, 0, " ", "me"), (None, 1, "x", "no id"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'s' as speaker", "1 as part")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat_rotation.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "Ann_Lee", 0), (1, "Ann_Lee", 1), (1, "bob", 0), (1, "bob", 1), (3, "unknown", -1), (3, "unknown", 0), (None, "x", 0)}
    ann = got[1, "Ann_Lee", 0]
    assert ann["text"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nHé<|im_end|>\n")
    spans = [tuple(map(int, s.split(":"))) for s in ann["mask"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["Hi < |im_end|><|im_end|>"] and ann["n_turns"] == 3
    assert got[1, "bob", 1]["mask"] == "" and got[1, "bob", 1]["text"] == "<|im_start|>user name=Ann_Lee\n<|im_end|>\n"
    assert chat_rotation.rotate_perspectives(df.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (
        chat_rotation.rotate_perspectives(spark.read.parquet(f"{SF}/conversations.parquet")),
        line_dedup.deduplicate_lines(docs), licence_scan.scan_licences(docs),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- Licences


def test_licences(spark):
    notices = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "this work is licensed under the gnu general public license, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Copyright 2020 Example. All rights reserved.": "proprietary", "Licensed under the BSD 3-Clause License": "bsd",
        "She had no licence to drive the lorry home that night.": "unknown", "Permission was given by the mayor to hold the fair.": "unknown",
        "The warranty of the kettle ended last week.": "unknown",
    }
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("grams"), F.lit("f").alias("family"))
    rows = [(10_000 + i, f"Some words before.\n{line}\nand after.") for i, line in enumerate(notices)] + [(None, None), (None, "All rights reserved."), (10_100, "")]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as grams", "'f' as family"))
    got = licence_scan.scan_licences(df)
    assert {r["doc_id"]: (r["paragraph_no"], r["family"]) for r in got.where("doc_id >= 10000").collect()} == {
        10_000 + i: (1, family) for i, family in enumerate(notices.values())}
    assert [r["family"] for r in got.where("doc_id is null").collect()] == ["proprietary"]
    assert licence_scan.scan_licences(df.limit(0)).count() == 0


def test_licences_without_anchor_and_wrapped(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction."
    gpl = (
        " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * More words."
    )
    texts = {
        "Words of a story.\nReleased under the GNU GPL, version 2.\nMore words.": (1, "gpl"), "Released under CC BY 4.0.": (0, "cc-by"),
        f"Title\n\n{mit}\n\nThe end.": (2, "mit"), f"/*\n{gpl}\n */": (1, "gpl"), "The sun rose.\nLicensed under\nCC BY-SA 4.0.": (1, "cc-by-sa"),
        "He slept under the bridge.\nReleased under the MIT License.": (1, "mit"),
    }
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    rows = licence_scan.scan_licences(df).where("doc_id >= 20000").orderBy("paragraph_no").collect()
    named = [(r["doc_id"] - 20_000, r["paragraph_no"], r["family"]) for r in rows if r["family"] != "unknown"]
    for i, expected in enumerate(texts.values()):
        mine = [r[1:] for r in named if r[0] == i]
        assert mine and mine[0] == expected and {f for _, f in mine} == {expected[1]}, (i, mine, [r for r in rows if r["doc_id"] == 20_000 + i])


def test_licences_are_fitted_on_all_candidates(spark, monkeypatch):
    rows = [(i, f"The licence of boat {i} was under the bridge {i * 7}.\nNothing more.") for i in range(6000)]
    used, fit = [], licence_scan.LogisticRegression.fit
    monkeypatch.setattr(licence_scan.LogisticRegression, "fit", lambda self, data: (used.append(data.count()), fit(self, data))[1])
    df = spark.createDataFrame(rows + [(9000, "Released under the MIT License.")], "doc_id bigint, text string")
    got = licence_scan.scan_licences(df)
    assert got.where("family <> 'unknown'").select("doc_id", "family").collect() == [(9000, "mit")]
    # One half of the documents; the other half is for the threshold.
    assert used[0] > 2800 and got.count() == 6001


def test_pairs_of_templates_are_looked_up_not_intersected(spark):
    words = spark.createDataFrame([("under the mit license under the".split(),), ([],)], "words array<string>")
    hits = words.select(licence_scan._hits(F.col("words")).alias("hits"))
    assert [sorted(r["hits"]) for r in hits.collect()] == [["mit license", "the mit", "under the"], []]
    assert "array_intersect" not in hits._jdf.queryExecution().toString()


# --- Quality


@pytest.fixture(scope="module")
def quality_tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_labels(spark, quality_tables):
    docs, labels = quality_tables
    held = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0)
    scores = cotraining.score_documents(docs, labels.join(held, "doc_id", "left_anti"))
    rows = scores.join(held, "doc_id").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in rows if r["kept"] == (r["quality"] == 1))
    assert right >= 0.97 * sum(r["count"] for r in rows)
    good = {r["kept"]: r["count"] for r in rows if r["quality"] == 1}
    assert good.get(False, 0) <= 0.02 * sum(good.values())


def test_quality_edge_rows(spark, quality_tables):
    docs, labels = quality_tables
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 30_000, None, None, None)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "1 as kept", "2 as _y", "3 as quality")
    scored = cotraining.score_documents(wide, labels.unionByName(labels).selectExpr("*", "'t' as text"))
    assert scored.count() == docs.count() + 3
    assert [(r["p_quality"], r["kept"]) for r in scored.where("doc_id is null").collect()] == [(0.0, False)]
    kept = cotraining.keep_good(wide, labels)
    assert kept.columns == wide.columns and 0 < kept.count() < wide.count()
    unfitted = cotraining.score_documents(wide, labels.limit(0))
    assert unfitted.where("not kept").count() == docs.where("text is null or trim(text) = ''").count() + 2
    assert cotraining.score_documents(docs.limit(0), labels).count() == 0


def test_views_teach_each_other():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = (rng.random(900) < 0.5).astype(float)
    text = rng.normal(size=(900, 5)) + truth[:, None]
    metadata = rng.normal(size=(900, 4)) + 1.5 * truth[:, None]
    y = np.where(np.arange(900) < 250, truth, np.nan)
    model = cotraining.cotrain(text, metadata, y)
    _, _, p = model.probabilities(cotraining._apply(model.text, text), cotraining._apply(model.metadata, metadata))
    assert model.pseudo_labels > 100 and ((p > 0.5) == (truth > 0.5))[250:].mean() > 0.93
