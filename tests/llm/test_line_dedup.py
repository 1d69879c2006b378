from collections import defaultdict

from kiln.llm.line_dedup import dedup_lines, frequent_lines, line_drop_bitmaps

LONG = "A line that is long enough to be a key of forty characters"
OTHER = "another line, that some documents repeat and which is long"


def brute(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]

    def key(x):
        return "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))

    for i, lines in split:
        for x in lines:
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(held[key(x)]) < min_docs or max(
            (d for d in held[key(x)] if d is not None), default=None) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_brute_force(docs_of):
    rows = [(i, f"start {i}\n {LONG.upper() if i % 2 else LONG}\t\n{LONG}\nend\n{OTHER if i < 4 else ''}") for i in range(9)]
    rows += [(20, None), (21, ""), (None, f"{LONG}\nx"), (8, rows[8][1]), (30, "\n".join([LONG, "b"] * 300)),
             (31, "short\n" * 5000), (32, "É" * 39), (33, "É" * 45)]
    got = sorted((tuple(r) for r in dedup_lines(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)
    assert dict((r[0], r[3]) for r in got)[30] == 0  # the largest document keeps all of them


def test_bitmaps_span_words(docs_of):
    rows = [(i, "\n".join([LONG, "x"] * 100)) for i in range(5)]
    got = {r["id"]: r for r in line_drop_bitmaps(docs_of(rows)).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r["n_dropped"] == 100 and len(r["dropped"]) == 4 for r in got.values())


def test_empty(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_first_occurrences_stream_over_the_sorted_ranges(docs_of):
    docs = docs_of([(i, "the same long line that many documents hold, once or twice\n" * 2) for i in range(9)])
    plan = frequent_lines(docs)._jdf.queryExecution().sparkPlan().toString()
    window = plan[plan.index("Window"):]
    assert "RepartitionByExpression" in window or "rangepartitioning" in window
    executed = frequent_lines(docs)._jdf.queryExecution().executedPlan().toString()
    below = executed[executed.index("Window"):]
    assert below.count("Sort [") == 1 and below.count("Exchange") == 1 and "rangepartitioning" in below
    assert "pos" in below[below.index("Sort ["):below.index("Exchange")]
    assert [(r["n_docs"], r["keeper"]) for r in frequent_lines(docs).collect()] == [(9, 8)]
