"""Mixing, line templates, near duplicates, decontamination, licences, scoring and language identification."""

import collections
import fractions
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import backoff_lm, decontaminate, language_crf, licenses, line_templates, mixing, near_dup
from gridloom.llm.bytetext import chunks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with odd rows: null, empty, blank, repeated, long, shouting, one word."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = base.orderBy("doc_id").first()
    odd = [
        (9001, None, None, None, None), (9002, "", "en", "odd", 0), (9003, " \n\t ", "en", "odd", 4), (9004, "word", "en", "odd", 4),
        (9005, "two words", None, "odd", 9), (9006, first.text.upper(), "en", None, 1), (9007, "lorem ipsum dolor " * 8000, "en", "long", 1),
        (9008, "12 34 !?", "en", "odd", 8), (9004, "word", "en", "odd", 4), (9009, first.text + " one more word here", "en", "near", 1),
    ]
    return base.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fill(sizes, weights, share=1.5, ceiling=2.0):
    """Targets by dealing the excess again until no source is above its ceiling."""
    target, open_, left = {}, dict(weights), share * sum(sizes.values())
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total > ceiling * sizes[s]]
        if not over:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_targets(spark, docs, rows):
    clash = docs.withColumns({"size": F.lit("x"), "_h": F.lit(1), "target": F.lit(2), "copies": F.lit(3)})
    got = mixing.curriculum_mix(clash).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert all(0 <= c.position <= 1 for c in r.copies)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    known = [r.position for r in got if r.position is not None]
    assert known == sorted(known)
    assert sorted(map(str, got)) == sorted(map(str, mixing.curriculum_mix(clash).collect()))
    assert mixing.curriculum_mix(empty(spark)).count() == 0


def test_mix_positions_follow_the_schedule(spark):
    one = spark.createDataFrame([(i, "a b c d e f g h i j", None, "s", 1) for i in range(400)], SCHEMA)
    plan = spark.createDataFrame([("s", [(0.0, 0.0), (1.0, 2.0)])], "source string, knots array<struct<t:double,w:double>>")
    order = mixing.training_order(mixing.curriculum_mix(one, plan)).collect()
    assert [c.position for c in order] == sorted(c.position for c in order)
    early = sum(c.words for c in order if c.position < 0.5)
    assert early / sum(c.words for c in order) == pytest.approx(0.25, abs=0.02)  # the integral of 2t up to one half


def lost_lines(rows, min_docs=3):
    """{(id, text): lines to drop}, from the template tree's definition."""
    lines = []  # (id, order of the text, line, tokens)
    for i, text in {(i, t) for i, t, *_ in rows if t}:
        for k, line in enumerate(text.split("\n")):
            tokens = tuple("#" if re.search("[0-9]", w) else w for w in words(line))
            if len(tokens) >= 3:
                lines.append((i, text, k, tokens))
    leaves = collections.defaultdict(list)
    for one in lines:
        t = one[3]
        rest, n = t[1:], len(t)
        blocks = 4 if n < 15 else 3
        part = [tuple(w for p, w in enumerate(rest) if p * blocks // (n - 1) == b) for b in range(blocks)]
        leaves["whole", t].append(one)
        if n >= 15:
            for b in range(3):
                leaves["one", n, t[0], b, part[b]].append(one)
        elif n >= 6:
            for b in itertools.combinations(range(4), 2):
                leaves["two", n, t[0], b, part[b[0]], part[b[1]]].append(one)
    lost = collections.defaultdict(set)
    level = leaves
    for _ in range(line_templates.HEADS):
        below = collections.defaultdict(list)
        for key, members in level.items():
            head = min(members, key=lambda m: (m[0], m[2]))[3]
            same = []
            for m in members:
                other = [p for p, (x, y) in enumerate(zip(m[3], head, strict=True)) if x != y]
                if 3 * (len(head) - len(other)) >= 2 * len(head):
                    same.append(m)
                else:
                    for p in other[: line_templates.SPLITS]:
                        below["part", key, p, m[3][p]].append(m)
            ids = {m[0] for m in same}
            if len(ids) >= (2 if key[0] == "whole" and len(key[1]) >= 50 else min_docs):
                for i, text, k, _ in same:
                    if i > min(ids):
                        lost[i, text].add(k)
        level = below
    return lost


def check_lines(df, rows):
    want = lost_lines(rows)
    got = line_templates.drop_recurring_lines(df).collect()
    assert len(got) == len(rows)
    expected = []
    for i, text, *_ in rows:
        gone = want.get((i, text), set())
        parts = [] if text is None else text.split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if k not in gone) if text is not None else None
        expected.append((i, kept, len(parts), len(gone)))
    assert sorted(expected, key=str) == sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str)
    return {r.doc_id: r.text for r in got}


def test_line_templates(spark):
    long = " ".join(f"word{chr(97 + i)}" for i in range(30))
    changed = long.replace("wordz", "other").replace("wordy", "fields")
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(52))
    rows = [
        (1, f"All rights reserved.\nfirst page body text\n{long}", "en", "a", 0),
        (2, f"All rights reserved.\nsecond page body text\n{changed}", "en", "a", 0),
        (3, f"All rights reserved.\nOf it.\n{long}\nOrder 77 shipped today", "en", "a", 0),
        (4, "Of it.\nOrder 12 shipped today", "en", "a", 0), (5, "Of it.\nOrder 5 shipped today\n\nend", "en", "a", 0),
        (6, None, "en", "a", 0), (7, "", "en", "a", 0), (8, "own line one two", "en", "a", 0), (8, "own line one two", "en", "a", 0),
        (9, "told two times only\ntold two times only", "en", "a", 0), (10, "told two times only", "en", "a", 0),
        (11, f"a\n{passage}", "en", "a", 0), (12, f"{passage}\nb", "en", "a", 0),
    ]
    names = ["ann", "bob", "cid", "dora"]
    for k, x in enumerate(names):
        y = names[k - 1]
        rows.append((20 + k, f"user {x} logged in from host {y} today ok\nsession opened for user {x} on the remote host called {y} at noon today ok\nown {x}", "en", "a", 0))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"lines": F.lit(1), "leaf": F.lit(2)})
    text = check_lines(df, rows)
    assert text[1] == rows[0][1]  # the first keeps everything
    assert text[2] == "second page body text" and text[3] == "Of it.\nOrder 77 shipped today"
    assert text[4] == "Of it." and text[5] == "Of it.\n\nend"  # a number is a field; short lines stay
    assert text[6] is None and text[7] == "" and text[8] == "own line one two"
    assert text[10] == "told two times only" and text[12] == "b"  # two documents are enough for a long line only
    assert text[20].count("\n") == 2 and [text[20 + k] for k in (1, 2, 3)] == ["own bob", "own cid", "own dora"]
    assert line_templates.drop_recurring_lines(empty(spark)).count() == 0


def test_an_odd_first_line_hides_no_template(spark):
    frame = "alpha bravo carol delta {} foxtrot golf hotel india juliet {} lima mike november"
    rows = [(k, frame.format(f"x{chr(97 + k)}", f"y{chr(97 + k)}"), "en", "a", 0) for k in range(1, 6)]
    odd = (0, "alpha bravo carol delta one two three four five six seven lima mike november", "en", "a", 0)
    alone = check_lines(spark.createDataFrame(rows, SCHEMA), rows)
    behind = check_lines(spark.createDataFrame([odd, *rows], SCHEMA), [odd, *rows])
    assert [alone[k] for k in range(2, 6)] == [""] * 4 and alone[1] == rows[0][1]
    assert {k: behind[k] for k in alone} == alone and behind[0] == odd[1]
    # a second odd line behind the first
    worse = (0, "alpha bravo carol delta nine eight seven six five four three lima mike november", "en", "b", 0)
    deep = check_lines(spark.createDataFrame([odd, worse, *rows], SCHEMA), [odd, worse, *rows])
    assert {k: deep[k] for k in alone if k} == {k: alone[k] for k in alone if k}


def test_no_number_of_odd_lines_hides_a_template(spark):
    def left(rows):
        return {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}

    # fields in the first places of difference from the odd line: the fixed ones behind them hold the template together
    frame = "alpha bravo carol delta echo {0}a {0}b {0}c {0}d kilo lima mike oscar papa"
    rows = [(k, frame.format("vwxyz"[k - 1]), "en", "a", 0) for k in range(1, 6)]
    odd = (0, "alpha bravo carol delta echo one two three four five six mike oscar papa", "en", "a", 0)
    text = left([odd, *rows])
    assert text[0] == odd[1] and text[1] == rows[0][1] and [text[k] for k in range(2, 6)] == [""] * 4
    # six odd lines, each of another place besides the fields: one head after the other before the template's
    words_of = [f"w{chr(97 + k)}" for k in range(25)]

    def line(own, place=None):
        w = [f"{own}{chr(97 + k)}" if 15 <= k < 23 else x for k, x in enumerate(words_of)]
        if place is not None:
            w[place] = f"{own}odd"
        return " ".join(w)

    odd = [(k, line(f"o{chr(97 + k)}", 9 + k), "en", "a", 0) for k in range(6)]
    rows = [(k, line(f"r{chr(97 + k)}"), "en", "a", 0) for k in range(10, 15)]
    text = left([*odd, *rows])
    assert [text[k] for k in range(6)] == [x[1] for x in odd] and text[10] == rows[0][1] and [text[k] for k in range(11, 15)] == [""] * 4


def lost_of_one_leaf(lines, least=3):
    """{(id, line)} dropped of (id, line, tokens) that share one leaf: three heads and splits, then all pairs of what is in no template."""
    agree = lambda x, y: 3 * sum(a == b for a, b in zip(x, y, strict=True)) >= 2 * len(x)
    lost, held, level = set(), set(), {"": lines}
    for tokens in {x[2] for x in lines}:  # exact copies
        level["whole", tokens] = [x for x in lines if x[2] == tokens]
    for _ in range(line_templates.HEADS):
        below = collections.defaultdict(list)
        for key, members in level.items():
            head = min(members)[2]
            same = [x for x in members if agree(x[2], head)]
            if len({x[0] for x in same}) >= least:
                held |= {x[:2] for x in same}
                lost |= {x[:2] for x in same if x[0] > min(same)[0]}
            for x in members:
                if not agree(x[2], head):
                    other = [p for p, (u, v) in enumerate(zip(x[2], head, strict=True)) if u != v]
                    for p in other[: line_templates.SPLITS]:
                        below[key, p, x[2][p]].append(x)
        level = below
    tree = set(lost)
    rest = [x for x in lines if x[:2] not in held]
    for x in rest:
        docs = {y[0] for y in rest if agree(x[2], y[2])}
        if len(docs) >= least and min(docs) < x[0]:
            lost.add(x[:2])
    return tree, lost


@pytest.mark.parametrize("block", [7, 1024])
def test_lines_in_no_template_meet_in_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line_templates, "BLOCK", block)
    rng = np.random.default_rng(21)
    # few words for each place; all lines share the leaf of their first block, and the others are of one word each for no two lines
    made = []
    for k in range(150):
        w = [f"w{chr(97 + i)}" if i < 6 else f"x{chr(97 + i)}{chr(97 + int(rng.integers(4)))}" for i in range(16)]
        w[10], w[15] = (f"own{chr(97 + k // 26)}{chr(97 + k % 26)}",) * 2
        made.append(" ".join(w))
    rows = [(k // 2 + 1, f"{made[k]}\n{made[k + 1]}", "en", "t", 1) for k in range(0, 150, 2)]
    rows += rows[:40:3]  # repeated rows
    lines = sorted({(i, k, tuple(x.split(" "))) for i, text, *_ in rows for k, x in enumerate(text.split("\n"))})
    tree, want = lost_of_one_leaf(lines)
    assert len(want) > len(tree) > 0
    for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        left = [k for k in range(2) if (r.doc_id, k) not in want]
        text = next(x[1] for x in rows if x[0] == r.doc_id).split("\n")
        assert (r.text, r.n_dropped) == ("\n".join(text[k] for k in left), 2 - len(left)), r.doc_id


def test_many_dropped_lines_of_one_text(spark):
    text = "\n".join(f"line of words number {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]}" for k in range(5000))
    rows = [(k, f"own start {'pqr'[k]} here\n{text}\nown end {'pqr'[k]} here", "en", "a", 0) for k in range(3)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and [(got[k].text, got[k].n_lines, got[k].n_dropped) for k in (1, 2)] == [
        (f"own start {x} here\nown end {x} here", 5002, 5000) for x in "qr"
    ]


def test_line_templates_match_brute_force(spark, docs, rows):
    rng = np.random.default_rng(8)
    extra = []
    for k in range(60):  # lines of a few frames with words exchanged, within and beyond the similarity
        made = []
        for frame in (7, 12, 15, 21):
            w = [f"f{chr(97 + frame)}{chr(97 + i)}" for i in range(frame)]
            for at in rng.choice(frame, int(rng.integers(0, frame // 2 + 1)), replace=False):
                w[at] = f"x{chr(97 + int(rng.integers(26)))}"
            made.append(" ".join(w))
        extra.append((30000 + k, "\n".join(made), "en", "t", 1))
    check_lines(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), [*rows, *extra])


def shingles(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
            i = len(x & y)
            if den * i >= num * (len(x) + len(y) - i):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, rows, width, num):
    rng = np.random.default_rng(3)
    base = words(rows[3][1])[:150]
    group = []
    for k in range(90):  # near copies around the threshold, of which only some link
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 9)), replace=False):
            w[at] = f"new{k}x{at}"
        group.append((20000 + k, " ".join(w), "en", "g", 1))
    frame = [f"frame{k}" for k in range(100)]
    for k in range(300):  # a common frame and own words: in one cluster by their bands, none a duplicate but the last
        own = [f"own{k if k < 299 else 0}x{j}" for j in range(50)]
        group.append((40000 + k, " ".join(frame + own + [f"end{k}"]), "en", "f", 1))
    extra = spark.createDataFrame(group, SCHEMA)
    got = near_dup.near_duplicates(docs.unionByName(extra).withColumn("component_id", F.lit(5)), width, num, 100).collect()
    sets = {i: shingles(t, width) for i, t, *_ in [*rows, *group]}
    want = components(sets, num, 100)
    assert len(got) == len(rows) + len(group)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_large_clusters_are_cut_to_what_may_link(spark):
    rng = np.random.default_rng(5)
    sets = []
    for k in range(600):  # one cluster of two frames, whose texts share no more than their frame
        frame = np.arange(100) * 7919 + 10**9 * (k % 2)
        sets.append((1, k, np.sort(np.concatenate((frame, rng.integers(2**40, 2**60, 50)))).tolist()))
    for k in range(200):  # near copies stay together
        sets.append((2, 1000 + k, np.sort(np.concatenate((np.arange(150) + 10**12, rng.integers(2**40, 2**60, 5)))).tolist()))
    twin = sets[0][2][:-1]
    df = spark.createDataFrame([*sets, (1, 700, twin), (3, 2000, [1, 2]), (3, 2001, [1, 2, 3])], "cluster long, id long, hashes array<long>")
    got = near_dup._cut(df, 85, 100).collect()
    assert all(sorted(r.hashes) == r.hashes for r in got)
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.id)
    assert sorted(groups.values(), key=min) == [{0, 700}, set(range(1000, 1200)), {2000, 2001}]


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (3, a + " x"), (7, b + " y"), (9, b), (None, a), (2, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {
        (5, 3, False), (3, 3, True), (7, 3, False), (9, 3, False), (None, None, None), (2, 2, True)
    }


def test_fast_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:850], rng.integers(0, 2**63, 150, dtype=np.uint64)))
    row = np.repeat([0, 1, 3], [1000, 1000, 1])
    s = near_dup.fast_sketches(row, np.concatenate((a, b, a[:1])), 4)
    none = np.uint64(2**64 - 1)
    assert (s[[0, 1, 3]] != none).all() and (s[2] == none).all()
    assert (s[0] == s[1]).mean() == pytest.approx(850 / 1150, abs=0.15)


def test_decontamination(spark):
    item = "so Tom has 3 apples and Ann has 17 kg of pears but Tom wants 3 more than Ann today"
    texts = {
        1: "before it. " + item + " after it.", 2: item.upper(), 3: item.replace("Tom", "Bob").replace(" 3 ", " 5 ").replace("Ann", "Eve"),
        4: item.replace("but Tom", "but Zed").replace("wants 3", "wants 9"), 5: None, 6: "", 7: "Nothing of it is here at all, really nothing.",
        8: "The house was so " + item[3:],
    }
    docs = spark.createDataFrame([(k, v, "en", "a", 0) for k, v in texts.items()] + [(1, texts[1], "en", "a", 0)], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id long, text string")
    clash = docs.withColumns({"window": F.lit(1), "item_id": F.lit(2), "slots": F.lit(3)})
    got = {r.doc_id: r for r in decontaminate.contaminated_documents(clash, bench).collect()}
    assert set(got) == {1, 2, 3, 8}
    assert got[3].reworded and not got[1].reworded and got[1].coverage == 1.0
    kept = [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(kept) == [4, 5, 6, 7]
    assert decontaminate.contaminated_documents(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_documents(empty(spark), bench).count() == 0


def test_decontamination_is_the_same_without_broadcast(spark):
    item = "Tom has 3 apples and Ann has 17 kg of pears but Tom wants 3 more than Ann today"
    docs = [(1, f"We know that {item}".replace(" 3 ", " 5 "), "en", "a", 0), (2, item, "en", "a", 0), (3, "The house was so " + item[4:], "en", "a", 0), (4, "nothing of it is here at all", "en", "a", 0)]
    docs, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item), (2, "Paris is so far from the sea")], "item_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(5, "We think that Paris is so far from the sea", "en", "a", 0)], SCHEMA))
    with_broadcast = sorted(decontaminate.contaminated_documents(docs, bench, threshold=1.0).collect())
    old, decontaminate.MAX_BROADCAST_WINDOWS = decontaminate.MAX_BROADCAST_WINDOWS, 0
    try:
        assert sorted(decontaminate.contaminated_documents(docs, bench, threshold=1.0).collect()) == with_broadcast
    finally:
        decontaminate.MAX_BROADCAST_WINDOWS = old
    assert {(1, 1), (5, 2)} <= {(r.doc_id, r.item_id) for r in with_broadcast}


def typed_words(text):
    """[(placeholder or word, word behind a placeholder or None, word)] of a text, from the definition."""
    out, opening, number = [], True, False
    for line in (text or "").split("\n"):
        opening = True
        for raw in re.findall(r"[^\x20\x09-\x0D]+", line):
            word = raw.strip("!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~")
            if word:
                digit = bool(re.search("[0-9]", word))
                kind = "#" if digit else "unit" if number and word.lower() in decontaminate.UNITS else None
                if kind is None and len(word.encode()) > 1 and re.match("[A-Z][^A-Z]", word) and not opening:
                    kind = "Name"
                out.append((f"<{kind}>" if kind else word.lower(), word.lower() if kind else None, word.lower()))
                number = digit
            opening = raw[-1] in ".!?:"
    return out


def typed_windows(text, document):
    """({position: [(words, slots)]}, number of windows)."""
    w = typed_words(text)
    spans = [w[i : i + 5] for i in range(len(w) - 4)]
    good = [i for i, x in enumerate(spans) if sum(t[1] is None for t in x) >= 2]
    forms = collections.defaultdict(list)
    none = (None,) * 5
    for i, x in enumerate(spans):
        template, slots, plain = zip(*x, strict=True)
        if i in good:
            forms[i].append((template, slots))
            if any(slots):
                forms[i].append((plain, none))
            if document and slots[0]:
                forms[i].append((plain[:1] + template[1:], (None, *slots[1:])))
        elif document or not good:
            forms[i].append((plain, none))
    return forms, len(good) if good or document else len(spans)


def leaked(docs, items, threshold):
    found = {}
    items = {k: typed_windows(t, False) for k, t in items.items()}
    for d, text in docs.items():
        at = collections.defaultdict(list)
        for p, forms in typed_windows(text, True)[0].items():
            for words_, slots in forms:
                at[words_].append((p, slots))
        for k, (forms, n) in items.items():
            hits = []
            for q, variants in forms.items():
                for words_, slots in variants:
                    for p, other in at.get(words_, []):
                        hits.append((q, p, {(a, b): (q + j, p + j) for j, (a, b) in reversed(list(enumerate(zip(slots, other, strict=True)))) if a}))
            support, order = collections.defaultdict(set), {}
            for q, _, pairs in hits:
                for x, place in pairs.items():
                    support[x].add(q)
                    order[x] = min(order.get(x, place), place)
            same = {q for q, _, pairs in hits if pairs and all(a == b for a, b in pairs)}
            ways = []
            for fixed in (True, False):
                taken = sorted({x for _, _, pairs in hits for x in pairs if fixed and all(a == b for a, b in pairs)})
                for x in sorted(support, key=lambda x: (-len(support[x]), x[0] != x[1], order[x])):
                    if all(x[0] != a and x[1] != b for a, b in taken):
                        taken.append(x)
                use = [h for h in hits if fixed or h[2] or h[0] not in same]
                ways.append([(q, any(a != b for a, b in pairs)) for q, _, pairs in use if all(x in taken for x in pairs)])
            good = max(ways, key=lambda g: len({q for q, _ in g}))
            places = {q for q, _ in good}
            if n and len(places) >= threshold * n - 1e-9:
                found[d, k] = (len(places), n, any(all(c for q2, c in good if q2 == q) for q in places))
    return found


def test_decontamination_matches_brute_force(spark, docs, rows):
    rng = np.random.default_rng(4)
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    frame = "which of the following is true when {} has {} kg of {} and {} has {} more than {} on day {} of the year"
    names, things = ["Tom", "Ann", "Bob", "Eve", "Zed"], ["pears", "nuts", "corn"]
    for k in range(12):  # items with a common stock question
        a, b = rng.choice(names, 2, replace=False)
        bench[9000 + k] = frame.format(a, k, things[k % 3], b, k + 3, a, k % 5) + f" asks word{k} and other{k}"
    bench[9100] = "Ann Bob 12 Tom 7 Zed Eve 99 Ann"  # no window with two plain words
    texts = {i: t for i, t, _ in rows if i < 9000}
    for k in range(80):
        t = bench[9000 + k % 12]
        for _ in range(int(rng.integers(0, 4))):
            old, new = rng.choice(names, 2, replace=False)
            t = t.replace(old, new, int(rng.integers(1, 4)))
        w = t.split()
        for at in rng.choice(len(w), int(rng.integers(0, 3)), replace=False):
            w[at] = rng.choice(["5", "that", "Max", "kg"])
        texts[50000 + k] = "We ask: " + " ".join(w) + ". It ends."
    texts |= {50100: "so Ann Bob 12 Tom 7 Zed Eve 99 Ann it was", 50101: "so Ann Bob 13 Tom 7 Zed Eve 99 Ann it was"}
    for i, (k, t) in enumerate(sorted(bench.items())[:6]):
        texts[50200 + i] = f"before it {t} after it"
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    items = spark.createDataFrame(sorted(bench.items()), "item_id long, text string")
    want = leaked(texts, bench, 0.8)
    got = decontaminate.contaminated_documents(df, items).collect()
    assert {(r.doc_id, r.item_id): (r.matched_windows, r.item_windows, r.reworded) for r in got} == want and len(got) == len(want)
    assert (50100, 9100) in want and (50101, 9100) not in want and any(v[2] for v in want.values())


def test_a_changed_slot_costs_its_windows_only(spark):
    """The largest consistent set of slots decides, whatever the alignment."""
    item = "a farmer buys 3 crates of ripe apples at the old market in town and then he slowly carries all 3 crates home over the long stone bridge before the heavy rain begins to fall"
    baker = "the old baker Anna gives some warm bread to all of the hungry children in town and then the very same baker Anna walks home"
    texts = {
        1: item.replace("all 3", "all 5"), 2: item.replace("3", "9"), 3: item.replace("slowly carries", "slowly and carries"), 4: item,
        5: baker.replace("Anna", "Bella", 1).replace("hungry children", "hungry little children").replace("Anna", "Clara"), 6: baker.replace("Anna", "Bella"),
    }
    docs = spark.createDataFrame([(k, "We read that " + v, "en", "a", 0) for k, v in texts.items()], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, baker)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated_documents(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2)}
    assert got[1, 1].coverage == pytest.approx(25 / 30, abs=0.04) and got[2, 1].reworded and not got[4, 1].reworded
    low = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated_documents(docs, bench, threshold=0.5).collect()}
    assert low[5, 2] < 0.75


def test_one_row_of_an_id_survives_near_dedup(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text), (2, text), (3, "other words that nothing else has in it"), (3, "another text of the same id as that one"), (4, ""), (4, ""), (None, text), (None, text), (5, "alone in the world of words here")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]


def test_every_verbatim_benchmark_passage_is_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = {r.doc_id: f" {plain(r.text)} " for r in docs.collect()}
    want = {d for d, t in texts.items() for r in bench.collect() if f" {plain(r.text)} " in t}
    assert {r.doc_id for r in decontaminate.contaminated_documents(docs, bench).collect()} == want


def license_score(text, template):
    """Greatest Dice coefficient of the runs that begin and end with stretches of template bigrams, as a fraction or None."""
    grams = lambda t: list(itertools.pairwise(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))))
    have, want = grams(text), set(grams(template))
    on = [g in want for g in have]
    first = [i for i, x in enumerate(on) if x and not (i and on[i - 1])]
    last = [i for i, x in enumerate(on) if x and not (i + 1 < len(on) and on[i + 1])]
    most = fractions.Fraction(3, 2) * len(want)  # a set this many times larger has 0.8 at best
    best = None
    for a, end in zip(first, last, strict=True):
        for b in last:
            if b >= a and (b == end or b - a + 1 <= most):
                piece = set(have[a : b + 1])
                value = fractions.Fraction(2 * len(piece & want), len(piece) + len(want))
                if value >= fractions.Fraction(4, 5) and (best is None or value > best):
                    best = value
    return best


def test_licenses_match_sql_and_brute_force(spark, docs):
    t, rng = licenses.TEMPLATES, np.random.default_rng(5)
    notice = t["Apache-2.0-notice"].replace(" (the", "\n(the").replace(" See the", "\nSee the")
    mit = t["MIT"].replace("conditions: The", "conditions:\n\nThe").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    around = "many other words of a page " * 60
    texts = {
        9101: f"Title of a page\n\n{notice}\n\nmore text\nlast", 9102: t["MIT"].upper(), 9103: "released under an MIT license",
        9104: "LICENSED UNDER THE APACHE LICENSE, version 2.0", 9105: f"{around}\n\n{mit}\n\n{around}", 9106: f"{around}{t['GPL-3.0-notice']} {around}",
        9107: "Acme. All rights reserved.", 9108: "Licensed under CC BY-NC", 9109: "all rights", 9110: "All rights reserved. " * 500,
        9111: "we say licensed under CC BY-NC and more", 9112: (mit + "\n") * 4, 9113: "rights reserved all rights",
    }
    for k in range(40):  # notices with words changed, near and below the threshold
        w = t["MIT" if k % 2 else "Apache-2.0-notice"].split()
        for at in rng.choice(len(w), int(rng.integers(0, len(w) // 4)), replace=False):
            w[at] = rng.choice(["software", "of the", "other", ""])
        texts[9200 + k] = "a b " + " ".join(w) + " c the d"
    extra = [(k, v, "en", "l", 1) for k, v in texts.items()]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumns({"licenses": F.lit(0), "_grams": F.lit(1)})
    rows = licenses.license_matches(both).collect()
    con = duckdb.connect()
    con.register("documents", both.drop("licenses").toPandas())
    want = con.sql(licenses.dice_sql()).fetchall()
    got = [(r.doc_id, r.best_license, round(b.dice, 9) if b else None, len(r.licenses), b.start if b else None, b.words if b else None)
           for r in rows for b in [r.licenses[0] if r.licenses else None]]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = {r.doc_id: r.text for r in both.collect()}
    for r in rows:
        score = {name: license_score(full[r.doc_id], text) for name, text in t.items()}
        assert {x.license: x.dice for x in r.licenses} == {k: float(v) for k, v in score.items() if v is not None}, r
    best = {r.doc_id: r.best_license for r in rows}
    assert best[9101] == "Apache-2.0-notice" and best[9102] == "MIT" and best[9104] == "Apache-2.0-line" and best[9001] is None
    assert best[9105] == "MIT" and best[9106] == "GPL-3.0-notice" and best[9107] == "all-rights-reserved" and best[9112] == "MIT"
    dice = {r.doc_id: r.licenses[0].dice for r in rows if r.licenses}
    assert best[9108] == best[9111] == "CC-BY-NC-4.0-line" and dice[9108] == dice[9111] == 0.8 and best[9103] is None and best[9109] is None
    assert licenses.license_matches(empty(spark)).count() == 0 and licenses.license_matches(docs, {"x": "word"}).filter("best_license is not null").count() == 0


def test_license_bounds_and_anchors_lose_nothing():
    for size in range(1, 200):
        can = [a for a in range(1, 400) if 2 * min(a, size) * 5 >= 4 * (a + size)]
        assert licenses.size_bounds(size) == (can[0], can[-1])
    for text in licenses.TEMPLATES.values():
        grams = licenses.template_bigrams(text)
        anchors = set(licenses.anchor_words(grams))
        free = [g for g in grams if not anchors & set(g.split(" "))]
        assert len(free) < max(licenses.size_bounds(len(grams))[0], 1)


class Ngrams:
    """Dirichlet-smoothed n-grams by their definition, over tuples of words."""

    def __init__(self, texts):
        self.count, self.context = collections.Counter(), collections.Counter()
        for t in texts:
            s = ["\0begin", *words(t), "\0end"]
            for i in range(1, len(s)):
                for k in range(min(i, 2) + 1):
                    self.count[tuple(s[i - k : i + 1])] += 1
                    self.context[tuple(s[i - k : i])] += 1
        self.vocabulary = [g[0] for g in self.count if len(g) == 1]

    def p(self, context, word):
        if not context:
            return (self.count[word,] + 0.1) / (self.context[()] + 0.1 * (len(self.vocabulary) + 1))
        shorter = self.p(context[1:], word)
        n = self.context[context]
        return (self.count[*context, word] + 4 * shorter) / (n + 4) if n else shorter

    def score(self, text):
        s = ["\0begin", *words(text), "\0end"]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))


def test_language_model_matches_brute_force(spark, docs, rows):
    old, backoff_lm.BLOCK_BYTES = backoff_lm.BLOCK_BYTES, 100_000  # several blocks and hash ranges
    try:
        got = backoff_lm.score_documents(docs.withColumns({"train": F.lit(0), "block": F.lit(1)})).collect()
    finally:
        backoff_lm.BLOCK_BYTES = old
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    model = Ngrams(t for i, t, _ in rows if not held[i])
    text_of = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        s = [*words(text_of[r.doc_id]), "\0end"]
        known = sum(model.count[w,] > 0 for w in s)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(s), known, model.context[()])
        assert r.base_score == pytest.approx(sum(math.log10(model.p((), w)) for w in s)) and r.score == pytest.approx(model.score(text_of[r.doc_id]))
    assert backoff_lm.score_documents(empty(spark)).count() == 0


def test_language_model_states_sum_to_one(spark):
    train = ["a b a c", "a b b d", "c a d", "b", "e e e a", "u1 a u1 a u1 a u1 a u2 b u2 c u2 d u2 e"]
    model = Ngrams(train)
    for context in model.context:
        assert sum(model.p(context, w) for w in [*model.vocabulary, "unseen"]) == pytest.approx(1)
    # the operator's own probabilities: what a text's score gains by each next word from a state, the end included
    known = sorted(w for w in model.vocabulary if w != "\0end")
    heads = ["a", "a b", "u1", "u1 a", "x", "e e", "c zz"]
    texts = [f"{h} {w}".strip() for h in heads for w in ["", *known, "unseen"]]
    df = spark.createDataFrame(list(enumerate([*train, *texts])), "doc_id long, text string")
    score = {r.doc_id - len(train): r.score for r in backoff_lm.score_documents(df.repartition(3), train=F.col("doc_id") < len(train)).collect()}
    for k, text in enumerate(texts):
        assert score[k] == pytest.approx(model.score(text))
    n = len(known) + 2
    for h, head in enumerate(heads):
        s = ["\0begin", *head.split()]
        path = sum(math.log10(model.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))
        total = 10 ** (score[h * n] - path)
        for k, w in enumerate([*known, "unseen"], 1):
            total += 10 ** (score[h * n + k] - path - math.log10(model.p((s[-1], w), "\0end")))
        assert total == pytest.approx(1)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    score, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    m = language_crf.Model(["a", "b", "c"], None, None, None, trans, start)
    count = np.array([4, 0, 1, 4])
    gamma, pairs = language_crf.forward_backward(score, count, m, transitions=True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in count[count > 0]:
        want, z, ex = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = math.exp(start[path[0]] + sum(score[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            z += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in itertools.pairwise(path):
                ex[a, b] += p
        assert gamma[at : at + n] == pytest.approx(want / z)
        want_pairs += ex / z
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_forward_backward_of_long_rows_is_the_same_by_segments():
    rng = np.random.default_rng(2)
    count = np.array([700, 3, 0, 16, 17, 255, 1])
    m = language_crf.Model(["a", "b", "c"], None, None, None, rng.normal(size=(3, 3)), rng.normal(size=3))
    score = rng.normal(size=(count.sum(), 3)) * 3
    whole, language_crf.SEGMENT = language_crf.SEGMENT, 10_000
    try:
        want, want_pairs = language_crf.forward_backward(score, count, m, transitions=True)
        language_crf.SEGMENT = 16
        got, pairs = language_crf.forward_backward(score, count, m, transitions=True)
        single, _ = language_crf.forward_backward(score.astype(np.float32), count, m)
    finally:
        language_crf.SEGMENT = whole
    assert got == pytest.approx(want) and pairs == pytest.approx(want_pairs) and single == pytest.approx(want, abs=1e-4)


def test_many_languages_take_few_bytes_at_a_time(monkeypatch):
    """Scores don't depend on how many bytes are weighed at a time; transitions are sums over pairs of words."""
    rng = np.random.default_rng(0)
    k = 200
    weight = rng.standard_normal((2**language_crf.BITS + 1, k)).astype(np.float32)
    weight[-1] = 0
    c = next(chunks(pa.array(["some words of été here", None, "", "a", "1 2 3 x", "long " * 300])))
    lexicon = np.unique(language_crf.features(c)[2][:3])
    m = language_crf.Model([f"l{i}" for i in range(k)], weight, lexicon, rng.standard_normal((len(lexicon), k)).astype(np.float32), rng.standard_normal((k, k)) * 0.1, np.zeros(k))
    whole, has = language_crf.emissions(c, m)
    monkeypatch.setattr(language_crf, "SCORES", 1000)
    few, has_too = language_crf.emissions(c, m)
    assert np.allclose(whole, few, atol=1e-4) and (has == has_too).all() and whole.shape == (len(c.start), k)
    count = c.word_counts()
    gamma, pairs = language_crf.forward_backward(whole.astype(float) * 0.1, count, m, transitions=True)
    assert np.allclose(gamma.sum(axis=1), 1) and pairs.sum() == pytest.approx(np.maximum(count - 1, 0).sum())


def test_every_labelled_language_is_learned(spark):
    rows = [(k, f"wort{k % 70} mit{k % 70} sprache{k % 70}", f"l{k % 70}", "s", 1) for k in range(210)]
    sample = language_crf.training_sample(spark.createDataFrame(rows, SCHEMA))
    assert sample.lang.nunique() == 70


def test_language_identification(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_crf.fit(language_crf.training_sample(docs.filter(~held)))
    got = language_crf.predict_languages(docs.withColumn("lang_pred", F.lit(1)), model)
    j = docs.filter("doc_id < 9000").join(got, "doc_id").filter(held)
    assert j.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95
    odd = {r.doc_id: r for r in got.collect() if r.doc_id >= 9000}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (9001, 9002, 9003, 9008))
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for i, r in odd.items() if i not in (9001, 9002, 9003, 9008))
    kept = language_crf.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (9001, 9002, 9003, 9008)").count() == 0
    none = language_crf.fit(language_crf.training_sample(docs.filter("lang is null")))
    assert {r.lang_pred for r in language_crf.predict_languages(docs, none).collect()} == {"und"}
    assert language_crf.predict_languages(empty(spark), model).count() == 0


def test_code_switched_words_are_labelled(spark, docs):
    model = language_crf.fit(language_crf.training_sample(docs))
    by = {}
    for r in docs.filter("lang is not null and n_chars > 500").collect():
        by.setdefault(r.lang, r.text.replace("\n", " ").split()[:40])
    c = next(chunks(pa.array([" ".join(by["de"] + by["es"])])))
    e, _ = language_crf.emissions(c, model)
    gamma, _ = language_crf.forward_backward(e.astype(float), c.word_counts(), model)
    best = [model.languages[k] for k in gamma.argmax(axis=1)]
    assert sum(b == "de" for b in best[:40]) >= 34 and sum(b == "es" for b in best[40:]) >= 34


def _peak_mb(rows):
    import tracemalloc

    tracemalloc.start()
    for _ in rows:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_a_batch_takes_bounded_memory_in_a_worker():
    """Two workers share an executor with its JVM: chunks, not batches, bound what they hold."""
    rng = np.random.default_rng(3)
    vocabulary = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(2000)])
    texts = [" ".join(rng.choice(vocabulary, 600)) for _ in range(1000)]
    k = 4
    model = language_crf.Model(list("abcd"), np.zeros(((1 << language_crf.BITS) + 1, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k)), np.zeros(k))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], names=["t", "l"])
    assert _peak_mb(iter(language_crf._predict(model, batch, batch.column(0), batch.column(1)) for _ in range(1))) < 60
    # pairs of a document and an item with many windows
    window = {"item_pos": 0, "pos": 0, "item_slots": [1, 2, 3, 4, 5], "slots": [6, 7, 8, 9, 10]}
    rows = [{"id": i, "item_id": 0, "item_windows": 60, "windows": [window | {"item_pos": q, "pos": q} for q in range(60)]} for i in range(1000)]
    pairs = pa.RecordBatch.from_pylist(rows)
    del rows
    assert _peak_mb(decontaminate._covered(0.8)(iter([pairs]))) < 10
