import random

import pytest

from tablecraft.llm import line_dedup
from tablecraft.llm.oracles import oracle_sql
from tablecraft.llm.queries import queries
from verification.compare import connect, differences


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs):
    """Kept text, lines and dropped lines per document, by comparing all lines."""
    seen, result = [], {}
    for doc_id, text in docs:
        kept, lines, dropped = [], 0, 0
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if not line:
                kept.append(raw)
                continue
            lines += 1
            fuzzy = len(line) >= line_dedup.MIN_FUZZY
            if any(
                line == other
                or fuzzy and len(other) >= line_dedup.MIN_FUZZY and within_one(line, other)
                for other in seen
            ):
                dropped += 1
            else:
                kept.append(raw)
            seen.append(line)
        result[doc_id] = (None if text is None else "\n".join(kept), lines, dropped)
    return result


def found(frame):
    return {r["doc_id"]: (r["text"], r["__lines"], r["__dropped"]) for r in frame.collect()}


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(line_dedup.dedup_lines(docs)) == plain(enumerate(texts))


@pytest.mark.parametrize("length", [16, 17, 31, 64])
def test_every_single_edit_is_found(spark, length):
    random.seed(length)
    base = "".join(random.choice("abcdefgh é") for _ in range(length - 2))
    base = f"x{base}y"
    edits = [base[:i] + "Z" + base[i + 1 :] for i in range(length)]
    edits += [base[:i] + "Z" + base[i:] for i in range(length + 1)]
    edits += [base[:i] + base[i + 1 :] for i in range(length)]
    twice = ["Q" + e[1:-1] + "R" for e in edits[5:8]]  # two edits away from the base
    random.shuffle(edits)
    check(spark, [base, *(f"  {e}\t" for e in edits), *twice])


def test_random_families(spark):
    random.seed(3)
    lines = []
    for _ in range(12):
        base = "".join(random.choice("ab c") for _ in range(random.randrange(10, 60)))
        lines.append(base)
        for _ in range(8):
            i = random.randrange(len(base))
            line = random.choice([base[:i] + "b" + base[i:], base[:i] + base[i + 1 :]])
            lines += [line, line[: i // 2] + "c" + line[i // 2 + 1 :]]
    random.shuffle(lines)
    check(spark, ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)])


def test_edge_cases(edge_docs, no_docs):
    result = line_dedup.dedup_lines(edge_docs)
    assert result.columns == [*edge_docs.columns, "__lines", "__dropped"]
    rows = result.collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["text"] == "" and by_id[2]["__dropped"] == 1
    assert by_id[3]["text"] is None and by_id[4]["text"] == ""
    assert by_id[5]["text"] == " \t\n\x0b "
    assert by_id[9]["text"] == "line one\n\nline two" and by_id[9]["__lines"] == 4
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    line = "A line that every one of these rows repeats"
    rows = [
        (1, f"{line}\nfirst of its own"),
        (5, f"second of its own\n{line}"),
        (5, f"{line}\nthird of its own"),
        (None, f"{line}\nfourth of its own"),
        (None, line),
        (None, f"{line[:-1]}\n{line}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = line_dedup.dedup_lines(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in result) == sorted([
        (1, rows[0][1]), (5, "second of its own"), (5, "third of its own"),
        (0, "fourth of its own"), (0, ""), (0, ""),
    ])


def test_template_lines_make_no_pairs(spark, small):
    """Many lines of one form: rows made stay in proportion to the lines."""
    texts = [f"Order number {i:06d} was shipped on time" for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["__dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    expected = {i: int(any(within_one(t, u) for u in texts[max(0, i - 1000) : i]
                           )) for i, t in enumerate(texts[:60])}
    assert {i: rows[i] for i in expected} == expected


def test_query_equals_sql(spark, small):
    name = "op2_line_dedup"
    assert differences(queries()[name](spark, small), connect(small), oracle_sql()[name]) == []
