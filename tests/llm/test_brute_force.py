"""The operators' results against brute force, planted cases and plain versions."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from prismata.llm import decontaminate, licenses, line_dedup, mixing, pii, quality, sharding, substring_dedup

from .test_operators import ROWS, WORD, _edits, docs, empty  # noqa: F401


def _line_groups(rows):
    """Kept lines by a plain version: (doc_id, line_no, text) first of its class."""
    lines = sorted((i, n, t, x) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r"))
    texts = sorted({x for *_, x in lines})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(texts):
        for y in texts[k + 1 :]:
            if abs(len(x) - len(y)) <= 2 and (t := min(2, min(len(x), len(y)) // 12)) and _edits(x, y) <= t:
                root[find(x)] = find(y)
    return lines, find


def test_lines_removed_equal_brute_force(spark):
    a = "The quick brown fox jumps over it\nA second line that is long enough\nshort"
    rows = [(5, a), (5, a), (1, "The quick brown fox jumped over it\nother words on this one here"), (2, "short\n \nA second line that is long enougH"), (None, a), (7, None), (3, ""), (9, "x" * 900 + "\n" + "x" * 899 + "y")]
    lines, find = _line_groups(rows)
    first = {}
    for i, n, _, x in lines:
        first.setdefault(find(x), (i, n))
    want = {i: 0 for i, _ in rows if i is not None}
    seen = set()
    for i, n, _, x in lines:
        want[i] += (first[find(x)] != (i, n)) or ((i, n) in seen)
        seen.add((i, n))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {i: got[i].n_removed for i in want} == want
    assert got[None].n_removed == 0 and got[None].n_lines == 3 and got[5].n_lines == 6
    left = line_dedup.remove_lines(df).collect()
    assert len(left) == len(rows) and [r.text for r in left if r.doc_id is None] == [a]
    assert [r.text for r in left if r.doc_id == 5] == ["", ""] and [r.text for r in left if r.doc_id == 2] == [rows[3][1]]


def test_hot_segments_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", 4)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    base = [f"all of these begin alike {k:03d} and end alike as well {k * 37 % 101:03d}" for k in range(40)]
    texts = sorted({*base, *[b.replace("alike", "alyke", 1) for b in base[:5]], *[b[:-1] for b in base[5:9]]})
    rows = line_dedup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    name = {r.l1: r.line for r in rows.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.near_pairs(rows).collect()}
    assert got == {(x, y) for i, x in enumerate(texts) for y in texts[i + 1 :] if _edits(x, y) <= 2} and len(got) > 9


def test_lines_have_few_keys(spark, monkeypatch):
    listed = []
    monkeypatch.setattr(line_dedup, "_blocks", lambda keyed, hot, blocks=line_dedup._blocks: listed.append(keyed.select("l1", "key")) or blocks(keyed, hot))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in range(24, 84) for _ in range(2)]
    near = [(t + "é" if i % 2 else t[:9] + "é" + t[10:]) for i, t in enumerate(texts)]
    rows = line_dedup.lines(spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string"))
    name = {r.l1: r.line for r in rows.collect()}
    got = {frozenset((name[r.a], name[r.b])) for r in line_dedup.near_pairs(rows).collect()}
    assert got == {frozenset(x) for x in zip(texts, near, strict=True)}
    assert listed[0].count() <= 7.5 * len(name)  # twelve a line before


def test_targets_equal_water_filling(spark):
    sizes = {"a": 10, "b": 500, "é": 90, "zz": 7, None: 300, "c": 0}
    df = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, n_docs long, source_size long")
    names = sorted((k for k in sizes if k is not None), key=str) + [None]
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    left, open_, want = float(sum(sizes.values())), set(names), {}
    while True:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if 3 * sizes[k] <= level * weight[k]}
        if not full:
            break
        for k in full:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
        open_ -= full
    want |= {k: level * weight[k] for k in open_}
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets(spark):
    rows = [(i, f"s{i % 5}", " ".join(["w"] * (1 + i * 7 % 60))) for i in range(600)] + [(3, "s3", "w w"), (None, "s1", "w w w"), (None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    m = mixing.Mix(df)
    got = m.documents().collect()
    for source in {f"s{k}" for k in range(5)}:
        of = [r for r in got if r.doc_id is not None and f"s{r.doc_id % 5}" == source and r.target]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 60
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) and len(r.shards) * r["size"] == r.taken for r in got)
    assert all(0 <= s < 8 for r in got for s in r.shards)
    out = m.apply(df)
    assert out.columns == df.columns and out.count() == sum(len(r.shards) for r in got)
    by_shard = [sum(s == k for r in got for s in r.shards) for k in range(8)]
    assert min(by_shard) > 0 and max(by_shard) < 3 * statistics.mean(by_shard)


_PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _plain_spans(t):
    out = []
    for k, (kind, rx) in enumerate(_PLAIN.items()):
        for m in rx.finditer(t):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), k, m.end())] if ok else []
    return sorted(out)


def test_pattern_spans_equal_plain_expressions():
    import random

    rnd = random.Random(8)
    parts = ["@", ".", "a", "B9", "-", "+", " ", "1", "255", "256.", "4111 1111 1111 1111", "é", "(", ")", "1.2.3.4", "+1 (743) 555-3824", "x@y.de", "%", "0"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        assert pii.base_spans(t) == _plain_spans(t), t


def test_personal_data_of_repeated_and_missing_ids(spark):
    rows = [(9, "plain words stay here"), (9, "mail a@b.de zorblatt"), (9, "plain words stay here"), (None, "call +1 (743) 555-3824 now"), (None, "nothing at all"), (None, None), (4, ""), (5, "a@b.de " + "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = pii.find(df)
    assert got.count() == len(rows)
    left = pii.sanitise(df).collect()
    assert len(left) == len(rows) and sorted(r.text for r in left if r.doc_id == 9)[-1] == "plain words stay here"
    assert sum(r.text == "plain words stay here" for r in left) == 2 and any(r.text == "nothing at all" for r in left) and any(r.text is None for r in left)
    assert any(r.text and "[PHONE]" in r.text for r in left) and all(r.text.startswith("[EMAIL]") for r in left if r.doc_id == 5)


def test_clean_texts_keep_rare_words(spark):
    """A word that also stands in a text without the entity does not reveal it."""
    rows = [(0, "reach me at q@r.st about flimbo and zorp"), (1, "flimbo is a word of this text")] + [(10 + i, f"reach me at about and is a word of this text {i}") for i in range(300)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[1][1] and "flimbo" in got[0] and "zorp" not in got[0]


def test_shards_are_balanced_and_keep_equal_texts(spark):
    rows = [(i, f"text {i} " + "ab " * (i % 50)) for i in range(3000)] + [(10_000 + i, "the same text again") for i in range(40)] + [(20_000 + i, "heavy " * 30) for i in range(2500)] + [(None, None), (7, "text 7 again"), (7, "text 7 again")]
    got = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string")).select("_row.text", "_size", "_shard", "_slot").collect()
    sums = [sum(r["_size"] for r in got if r["_shard"] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 0.06 * statistics.mean(sums)
    assert len({r["_shard"] for r in got if r.text == "the same text again"}) == 1
    for k in range(8):
        slots = sorted(r["_slot"] for r in got if r["_shard"] == k)
        assert slots == list(range(len(slots)))


def test_edited_license_copies_are_found(spark):
    words = licenses.TEMPLATES["MIT"].split()
    edited = " ".join("changed" if i % 23 == 7 else w for i, w in enumerate(words))
    cut = " ".join(words[: len(words) // 2])
    rows = [(1, edited), (1, edited), (2, "before " * 3000 + edited + " after" * 3000), (3, cut), (4, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.license_id == "MIT") == [1, 1, 2] and all(0.8 <= r.coverage < 1 for r in got if r.license_id == "MIT")
    assert {(r.doc_id, r.license_id) for r in got if r.doc_id in (3, 4)} <= {(3, "MIT-terms")}  # half a text is not the text


def test_reparameterised_items_are_found(spark):
    frame = "A train leaves {a} at noon with {n} people and {m} bags while it rains all over the country and nobody sings"
    items = [(k, frame.replace("country", f"country number{'abcdefghij'[k]}").format(a="Bonn", n=12 + k, m=40 + k)) for k in range(10)]
    same = [(100 + k, "so it says " + t + " and so on") for k, t in items]
    other = [(200 + k, "so it says " + frame.replace("country", f"country number{'abcdefghij'[k]}").format(a="Rome", n=77, m=91)) for k, _ in items]
    edited = [(300 + k, t.replace("Bonn", "Kiel")) for k, t in items]
    clean = [(400, "A train leaves"), (401, "word " * 30_000), (402, None)]
    got = decontaminate.contaminated(spark.createDataFrame([*same, *other, *edited, *clean], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(b + k, k) for b in (100, 200, 300) for k in range(10)} <= found and not any(d >= 400 for d, _ in found)
    assert {r.reparameterised for r in got if r.doc_id - 100 == r.item_id} == {False}


def test_symbols_and_copied_lines(docs):  # noqa: F811
    for r in quality.signals(docs).select("_row.text", "n_symbols", "n_dup_lines").collect():
        t = r.text or ""
        kept = [x for x in t.split("\n") if WORD.search(x)]
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(kept) - len(set(kept))


def test_expectation_maximisation_finds_planted_classes(spark):
    import random

    rnd = random.Random(5)
    k = len(quality.RULES)
    rows = []
    for i in range(4000):
        good = i % 5 > 0
        rows.append((good, [-1 if rnd.random() < 0.1 else int(rnd.random() < (0.97 if good else 0.45)) for _ in range(k)]))
    df = spark.createDataFrame(rows, "good boolean, votes array<int>")
    fit = {tuple(r.votes): r.posterior for r in quality.posterior_of_patterns(df.select("votes")).collect()}
    right = sum((fit[tuple(v)] >= 0.5) == g for g, v in rows)
    assert right >= 0.95 * len(rows)


def test_kept_texts_match_their_digests(docs):  # noqa: F811
    import hashlib

    told = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for r in substring_dedup.remove_substrings(docs).collect():
        if r.n_removed:
            assert hashlib.sha256((r.text or "").encode()).hexdigest() == told[r.doc_id].kept_sha256
    assert substring_dedup.remove_substrings(docs).count() == len(ROWS)


def _stored(monkeypatch, name):
    """What ``near_pairs`` stores by this name, before it is run."""
    out = []
    for store in ("materialize", "materialize_by"):
        monkeypatch.setattr(line_dedup, store, lambda df, at, *column, store=getattr(line_dedup, store): out.extend([df] * (at == name)) or store(df, at, *column))
    return out


def test_near_copies_that_share_segments_do_not_all_meet(spark, monkeypatch):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(20)]
    texts = set()
    for _ in range(120):
        at, mark = rnd.randrange(20), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(4))
        texts |= {" ".join([*base[:at], base[at] + mark, *base[at + 1 :]])}
    texts = sorted(texts | {t[:-1] for t in sorted(texts)[:5]} | {t.replace(" ", "_", 2) for t in sorted(texts)[:5]})
    stored = _stored(monkeypatch, "line-candidates")
    rows = line_dedup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    name = {r.l1: r.line for r in rows.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.near_pairs(rows).collect()}
    assert got == {(x, y) for i, x in enumerate(texts) for y in texts[i + 1 :] if abs(len(x) - len(y)) <= 2 and _edits(x, y) <= 2} and len(got) > 9
    assert stored[0].count() < len(texts) * len(texts) // 10  # of half as many pairs again as that


def test_line_texts_are_shuffled_once(spark, monkeypatch):
    stored = _stored(monkeypatch, "line-texts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = line_dedup.lines(spark.createDataFrame([(i, f"one of the lines that are alike {i:03d}") for i in range(30)], "doc_id long, text string"))
        pairs = line_dedup.near_pairs(rows).count()
        plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert pairs == 435 and plan.count("Exchange hashpartitioning") == 1, plan
