import random

from eddyline.llm import pigeonhole as p
from hypothesis import given, settings
from hypothesis import strategies as st

ITEM = "The quick brown fox jumps over the lazy dog, and then it runs home through the wide green field."


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_ends(pattern, text):
    row = [list(range(len(pattern) + 1))]
    for c in text:
        prev, now = row[-1], [0]
        for j, y in enumerate(pattern, 1):
            now.append(min(prev[j] + 1, now[j - 1] + 1, prev[j - 1] + (c != y)))
        row.append(now)
    return [r[-1] for r in row[1:]]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_myers_equals_the_table(pattern, text):
    assert p.myers(pattern, text) == best_ends(pattern, text)


def test_normal_form_keeps_places():
    text = "  İstanbul\n\tIS  Here "
    at = p.places(text)
    assert len(at) == len(p.normal(text)) and "".join(p.lower(text[i]) if not text[i].isspace() else " " for i in at) == p.normal(text)


def test_edits_within_the_budget_are_found_and_more_are_not(spark):
    rng = random.Random(2)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 3
    item, rows, want = p.normal(ITEM), [], {}
    for i in range(60):
        text = list(item)
        for _ in range(i % 9):
            k = rng.randrange(len(text))
            rng.choice([lambda: text.__setitem__(k, "#"), lambda: text.pop(k), lambda: text.insert(k, "#")])()
        rows.append((i, filler + "".join(text).upper() + " " + filler))
        want[i] = min(best_ends(item, p.normal(rows[-1][1])))
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, " ")], "item_id long, text string")
    found = p.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    budget = p.budget(len(item))
    assert {r["doc_id"]: r["distance"] for r in found} == {i: d for i, d in want.items() if d <= budget}
    for r in found:
        cut = p.normal(rows[r["doc_id"]][1][r["start"] : r["end"]])
        assert distance(cut, item) == r["distance"] and r["item_id"] == 7


def test_planted_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    want = {(d, i["item_id"]) for d, t in docs for i in items if p.normal(i["text"]) in p.normal(t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in p.op2_pigeonhole(spark, folder).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_blocks_and_odd_rows(spark, frame, empty):
    df = frame("x " + ITEM + " y", "clean text of some words", ITEM.upper() + "\n" + ITEM)
    bench = spark.createDataFrame([(i, ITEM if i % 2 else f"another item number {i} which is long enough to count") for i in range(4)], "item_id long, text string")
    one, many = (sorted(map(tuple, p.contaminated(df, bench, block=b).collect()), key=str) for b in (1 << 21, 60))
    assert one == many and len(one) == 2 * (1 + 2 + 1 + 1)
    for block in (1 << 21, 60):
        clean = p.drop_contaminated(df, bench, block=block)
        assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {1, 3, 4}
    assert p.contaminated(empty, bench).count() == 0 and p.contaminated(df, bench.limit(0)).count() == 0
    assert p.drop_contaminated(df, bench.limit(0)).count() == df.count()
