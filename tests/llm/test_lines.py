import random

from newsgrid.llm.lines import dedup_lines, windows, without_runs
from newsgrid.llm.queries import QUERIES


def plain(docs, most=50):
    """Delete by comparing every run of lines with the first that is equal."""
    split = {}
    for key, text in docs:
        split[key] = [(n, line.strip()) for n, line in enumerate((text or "").split("\n"))
                      if line.strip()]
    first, later = {}, {}
    for key in sorted(split):
        lines = [x for _, x in split[key]]
        count = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += count[b]
                if total >= most:
                    run = tuple(lines[a:b + 1])
                    if first.setdefault(run, (key, a)) != (key, a):
                        later.setdefault(key, []).append((a, b + 1))
                    if total - count[a] - count[b] >= most:
                        break                     # shorter runs delete as much
    out = {}
    for key, text in docs:
        if key not in later:
            out[key] = text
            continue
        gone = {i for a, b in later[key] for i in range(a, b)}
        numbers = [n for n, _ in split[key]]
        dead = {numbers[i] for i in gone}
        for i in gone:
            if i + 1 in gone:
                dead |= set(range(numbers[i], numbers[i + 1]))
        out[key] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in dead)
    return out


def some_docs(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 7, 20, 30, 60])))
            for _ in range(40)]
    docs = []
    for i in range(n):
        lines = rng.choices(pool, k=rng.randrange(7))
        if docs and rng.random() < 0.5:
            other = (rng.choice(docs)[1] or "").split("\n")
            a = rng.randrange(len(other))
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = other[a:a + rng.randrange(1, 5)]
        if rng.random() < 0.2:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "  "]))
        docs.append((i, "\n".join(lines)))
    return docs


def test_windows():
    assert windows([60], 50) == [(0, 1)] and windows([49], 50) == [] and windows([], 50) == []
    assert windows([10, 45, 10, 45], 50) == [(0, 2), (1, 3), (2, 4)]


def test_against_brute_force(spark):
    docs = some_docs(120, 4)
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = plain(docs)
    assert {r.doc_id: r.text for r in got} == want
    assert sum(want[k] != t for k, t in docs) > 10


def test_frames(spark):
    long = " ".join(f"v{i}" for i in range(60))
    big = "\n".join(f"line {i} of many words" for i in range(30_000))
    docs = [(1, f"a\n{long}\nb", "x", 1), (2, f"c\n  {long} \nd", "y", 2), (3, None, None, 3), (4, "", "", 4),
            (None, long, "n", 5), (5, f"{long}\n\n{long}", "z", 6), (6, big, "", 7), (7, big, "", 8),
            (8, "short\nshort\nshort", "", 9), (9, "q\n" * 60, "", 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string, key int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert len(got) == len(docs) and list(got[1].asDict()) == df.columns
    assert got[1].text == docs[0][1] and got[2].text == "c\nd" and got[3].text is None
    assert got[4].text == "" and got[None].text == long and got[5].text == "" and got[6].text == big
    assert got[7].text == "" and got[8].text == docs[8][1]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in dedup_lines(df, spans="spans").collect()}
    assert spans[2] == [(1, 2)] and spans[1] == [] and spans[7] == [(0, 30_000)] and spans[3] == []
    assert dedup_lines(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [r.text for r in dedup_lines(same).collect()] == [long, long]
    assert without_runs("a\nb\n\nc\nd", [(0, 1), (1, 2), (2, 3)]) == ("d", 4, [(0, 4)])


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(docs)
    import hashlib
    rows = QUERIES["op10_line_dedup"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest(), r.doc_id
    assert any(r.n_removed for r in rows)
