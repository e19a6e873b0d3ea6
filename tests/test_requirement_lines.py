"""Requirements cut by blocks of lines against a plain loop over them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proofline.functions import fixed, text
from proofline.operators import requirement_lines


def loop(lines):
    """``code, title, description, numbers of the first range`` of each requirement."""
    reqs, running = [], 0
    first = lambda x: re.search(r"(\d+) V to (\d+)", x)
    for x in (x.strip() for x in lines if x):
        if len(x) < 15:
            continue
        m = re.match(r"(?i)(REQ[-_]\w*\d+): (.*)", x)
        if m:
            title = m[2].strip() or x
            reqs.append([m[1].upper().replace("_", "-"), title, x, first(title)])
        elif any(w in x.lower() for w in fixed.MODALS):
            last = reqs[-1] if reqs else None
            if last and (last[1] == last[2] or len(last[2]) < 80):
                last[2], last[3] = f"{last[1]}. {x}", last[3] or first(x)
            else:
                running += 1
                reqs.append([f"REQ-{running:03d}", x[:120], x, first(x)])
    return [(k, *r[:3], r[3] and (float(r[3][1]), float(r[3][2]))) for k, r in enumerate(reqs)]


def random_line(rng):
    kind = rng.random()
    pad = "w" * rng.choice([0, 1, 5, 20, 40, 43, 44, 45, 60, 90, 103, 104, 105, 130])
    span = " 5 V to 9 V" if rng.random() < 0.3 else ""
    if kind < 0.2:
        return f"req_a{rng.randrange(99)}: {pad}{span} x"
    if kind < 0.8:
        return f" {pad} unit shall z{span} "
    return rng.choice([None, "", "short", "a line that says nothing at all", "it shall"])


@pytest.mark.parametrize("block", [2, 17, 10_000])
def test_blocks_equal_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(requirement_lines, "BLOCK", block)
    rng = random.Random(block)
    docs = {d: [random_line(rng) for _ in range(rng.choice([0, 1, 30, 300]))] for d in range(15)}
    docs |= {50: [f"each unit shall {'y' * 120} {k}" for k in range(1_100)], None: ["it must be told apart"], 51: ["nothing in here is of use"]}
    rows = [(d, k, x) for d, lines in docs.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc long, line int, text string").repartition(5).withColumn("_n", F.lit("clash"))
    want = {d: loop(lines) for d, lines in docs.items() if loop(lines)}
    reqs = requirement_lines.requirement_lines(df, ["doc"], "line")
    got = {}
    for r in reqs.orderBy("doc", "ord").collect():
        p = r["parameters"]
        got.setdefault(r["doc"], []).append((r["ord"], r["req_code"], r["title"], r["description"], (p[0]["min_val"], p[0]["max_val"]) if p else None))
    assert got == want and want[50][-1][1] == "REQ-1100"
    if block == 17:  # the fold over whole texts gives the same rows
        whole = spark.createDataFrame([(d, "\n".join(x or "" for x in lines)) for d, lines in docs.items() if d != 50], "doc long, text string")
        fold = whole.select("doc", F.posexplode(text.extract_requirements(F.col("text"))).alias("ord", "r")).select("doc", "ord", "r.*")
        assert sorted(map(str, fold.collect())) == sorted(map(str, reqs.where("doc is null or doc <> 50").collect()))


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc long, line int, text string")
    assert requirement_lines.requirement_lines(df, ["doc"], "line").collect() == []


def test_blocks_in_sequence():
    """Lines of several blocks in one call get what each block's function says of them."""
    rng = random.Random(9)
    for _ in range(50):
        coded, open_ = [rng.random() < 0.2 for _ in range(4)], [rng.random() < 0.8 for _ in range(4)]
        length, title = [rng.randrange(15, 90) for _ in range(4)], [rng.randrange(1, 90) for _ in range(4)]
        columns = [requirement_lines.np.array(x) for x in (coded, length, title, open_, range(4))]
        _, head = requirement_lines.block_function(*columns)
        twice = [[*x, *x] for x in (coded, length, title, open_, list(range(4)))]
        begin = rng.randrange(requirement_lines.STATES)
        heads = requirement_lines.line_heads(*twice, [0] * 4 + [begin] * 4, [-1] * 8, 4)
        assert (heads[3], heads[7]) == (head[0], head[begin])
