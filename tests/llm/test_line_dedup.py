import random
import re
from collections import Counter, defaultdict

from mirrorsift.llm import line_dedup
from mirrorsift.llm.line_dedup import dedup_lines, line_report, removed_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    seen, want, where, sets = {}, {}, defaultdict(list), []
    for i, text in sorted(rows):
        out = []
        for k, line in enumerate(text.split("\n")):
            words = tuple(WORD.findall(line))
            if not words:
                continue
            if words in seen:
                out.append(k)
                continue
            own = frozenset(words[a : a + 5] for a in range(len(words) - 4)) or frozenset([words])
            shared = Counter(o for x in own for o in where[x])
            if any(100 * n >= 80 * (len(own) + len(sets[o]) - n) for o, n in shared.items()):
                out.append(k)
            seen[words] = 1
            sets.append(own)
            for x in own:
                where[x].append(len(sets) - 1)
        want[i] = out
    return want


def test_against_all_pairs(spark):
    rng = random.Random(8)
    base = [[f"b{j}w{k}" for k in range(rng.randint(5, 70))] for j in range(12)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(["zz", f"n{i}", words[0]])
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\t "]).join(words))
        lines += ["short line", ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want_some = {i: x for i, x in want.items() if x}
    for crowded, block, depth in ((64, 1024, 3), (2, 3, 1), (4, 16, 3)):
        assert {r["doc_id"]: r["removed"] for r in removed_lines(docs, depth=depth, crowded_from=crowded, block=block).collect()} == want_some
    kept = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    for i, text in rows:
        assert kept[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])


def test_rows_without_id_and_very_frequent_lines(spark):
    line = " ".join(f"w{k}" for k in range(60))
    near = line.replace("w20", "other")
    hot = [(i, "one two\nmine %d" % i) for i in range(1, 1300)]
    docs = spark.createDataFrame([(None, line + "\nfirst"), (-5, near), (1300, line), (1301, "one  two ")] + hot, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["removed"] for r in removed_lines(docs).collect()}
    assert got == {-5: [0], 1300: [0], 1301: [0], **{i: [0] for i in range(2, 1300)}}
    texts = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert texts[None] == line + "\nfirst" and texts[-5] == "" and texts[1] == "one two\nmine 1" and texts[7] == "mine 7"


def test_near_copies_that_share_a_frequent_passage(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{k}" for k in range(rng.choice([0, 2, 5, 30]))]
        words = own + passage
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"c{i}"
        rows.append((i, " ".join(words)))
    want = {i: x for i, x in brute(rows).items() if x}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for crowded, block in ((64, 1024), (8, 20)):
        assert {r["doc_id"]: r["removed"] for r in removed_lines(docs, crowded_from=crowded, block=block).collect()} == want


def test_odd_rows(odd, none):
    out = {r["doc_id"]: r for r in line_report(odd).collect()}
    assert line_report(odd).count() == odd.count()
    assert out[1]["n_lines"] == 0 and out[2]["n_lines"] == 1 and out[5]["n_removed"] == 0 and out[6]["removed"] == "0"
    assert out[8]["removed"] in ("0,1", "0,1,3")
    clean = dedup_lines(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r["doc_id"]: r["n_chars"] for r in clean.collect()}[6] == 0
    assert line_report(none).count() == 0 and dedup_lines(none).count() == 0


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_removed_lines_leave_texts_in_place(spark, monkeypatch, tmp_path):
    rows = [(i, f"same line\nown {i}\nsame line\nlast {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = {i: f"own {i}\nlast {i}" for i in range(1, 40)} | {0: "same line\nown 0\nlast 0"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_lines(docs)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want
        assert "hashpartitioning" not in _plan(out)
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 3)
        out = dedup_lines(docs)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want
        assert "hashpartitioning" in _plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_text_is_split_once(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nc")], "doc_id long, text string")
    out = dedup_lines(docs)
    assert [r["text"] for r in out.collect()] == ["a\nb\nc"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not any("lambdafunction(split(" in x or "split(text" in x.split("lambdafunction(", 1)[1] for x in plan.split("\n") if "lambdafunction(" in x)
