"""Cases where a query did less than the whole job."""

import duckdb
from pyspark.sql import functions as F

from lodeseek.functions import tasks
from lodeseek.plans.catalog import ORACLE, QUERIES


def test_requests_are_whole_texts(spark, tmp_path):
    """What stands after the 80th character of a text counts in all eight queries on requests."""
    from lodeseek.plans.text_queries import ASKS

    late = "x " * 60 + "traceback crash some_name importa hereda next.js redesign security"
    spark.createDataFrame([(0, ASKS.index(""), late)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = lambda name: QUERIES[name](spark, str(tmp_path)).first()
    assert row("classify_task").q == " " + late and row("classify_task").task != "no_code"
    assert row("needs_code").needs_code
    assert row("budget").task == row("classify_task").task
    assert row("complexity").complexity == "complex"
    assert (row("framework_mention").framework, row("framework_mention").framework_substring) == ("next", "next")
    assert row("relation_detect").relations == "HEREDA,IMPORTA"
    assert {"security", "traceback", "some_name", "name"} <= set(row("query_words").words.split())
    assert {"reviewing", "debugging"} <= {r.name for r in QUERIES["skill_match"](spark, str(tmp_path)).collect()}


def test_a_yes_is_letters_of_the_text(spark, tmp_path):
    """ß is one letter, also in capitals: it gives no SI; every other spelling of a yes counts."""
    texts = ["ein ßieö", "eßi ßí", "yeß", "SI", "sí", "Sí", "pos\u0131ble", "\u017fi", "oh yEs", "ye\u017f", "no", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = {r.item_id: r.llm_correct for r in QUERIES["benchmark_run"](spark, str(tmp_path)).collect()}
    assert [said[i] for i in range(len(texts))] == [False] * 3 + [True] * 7 + [False, None]
    sql = duckdb.sql(ORACLE["benchmark_run"].replace("FROM benchmark", f"FROM '{tmp_path}/benchmark.parquet/*.parquet'"))
    assert said == {r[0]: r[-1] for r in sql.fetchall()}


def test_expiry_to_the_nearest_second(spark, tmp_path):
    """Parts of a second round, they are not cut off: 11:55:00.6 counts as 11:55:01, which is alive at 12:00:00 with 300 seconds."""
    parts = ["54:59.999999", "55:00.000000", "55:00.499999", "55:00.500000", "55:00.500001", "55:00.999999", "55:01.000000", "55:01.500000"]
    rows = spark.createDataFrame([(i, f"2024-01-15 11:{p}") for i, p in enumerate(parts)] + [(90, None), (91, "1969-12-31 23:59:59.7"), (92, "2024-02-01 00:00:00")], "event_id long, ts string")
    rows.selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r.event_id for r in QUERIES["ttl_lookup"](spark, str(tmp_path)).collect())
    assert got == [4, 5, 6, 7, 92]
    sql = duckdb.sql(ORACLE["ttl_lookup"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'"))
    assert got == sorted(r[0] for r in sql.fetchall())


def test_edges_of_triggers(spark, tmp_path):
    """A trigger's word edge is that of ASCII words: testä, test½ and test with an accent of its own hold test."""
    words = ["testä", "tests\u0301", "testé x", "test½", "test", "testing", "test_x", "test1", "ätest", "testsuite", "TESTÖ", "contest."]
    rows = [(2 * i + 1, 0, w) for i, w in enumerate(words)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.k, r.name, r.score, r.place) for r in QUERIES["skill_match"](spark, str(tmp_path)).collect()}
    assert {words[(r[0] // 1000 - 1) // 2] for r in got if r[1] == "testing" and r[2] in (50, 150)} == set(words) - {"testing", "test_x", "test1", "testsuite"}
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == set(c.sql(ORACLE["skill_match"]).fetchall())


def test_ascii_edges_leave_other_escapes(spark):
    patterns = [r"tests?\b", r"\\b", r"\\\b", r"\Ba\b\b", r"\Q\b\E\b", r"\Q\b", r"[a\\]\bx", "plain", ""]
    got = [r.p for r in spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, p string").select("i", tasks.ascii_edges(F.col("p")).alias("p")).orderBy("i").collect()]
    word, no_word = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
    want = [f"tests?{word}", r"\\b", rf"\\{word}", f"{no_word}a{word}{word}", rf"\Q\b\E{word}", r"\Q\b", rf"[a\\]{word}x", "plain", ""]
    assert got == want


def test_nearest_by_blocks(spark, monkeypatch):
    """Many small cells: equal vectors, near ties, vectors without a direction; the plan has no join of all pairs."""
    import numpy as np

    from lodeseek.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", (64, 128))
    monkeypatch.setattr(vectors, "QUERIES", 20)
    monkeypatch.setattr(vectors, "PAIRS", 700)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).astype("float32")
    vecs = [*rng.normal(size=(300, 6)).astype("float32"), *base[rng.integers(0, 40, 100)], *[base[0]] * 90, *(base[:40] + 1e-7).astype("float32")]
    vecs = [v.tolist() for v in vecs] + [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(int(i), v, int(i) % 3) for i, v in zip(rng.permutation(len(vecs)), vecs, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.search_many(df, df.where("vec_id % 5 = 0").selectExpr("vec_id AS q_id", "embedding AS q_vec", "label AS ql"), 10)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()

    def score(a, b):
        if any(v is None or len(v) != 6 or None in v or not any(v) for v in (a, b)):
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    want = set()
    for q, v, ql in rows:
        if q % 5 == 0:
            of = sorted(((score(v, w), i, c) for i, w, c in rows if i != q), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
            want |= {(q, ql, i, c, p) for p, (_, i, c) in enumerate(of[:10], 1)}
    assert {(r.q_id, r.ql, r.vec_id, r.label, r.place) for r in got.collect()} == want


def test_evidence_over_all_parts_and_turns(spark, data):
    """Brute force over every turn and every part."""
    parts = [(r.p_partkey, r.p_name.split(" ")[1]) for r in spark.read.parquet(f"{data}/part.parquet").collect()]
    turns = spark.read.parquet(f"{data}/conversations.parquet").collect()
    last = {n.lower(): i for i, n in sorted(parts) if len(n) >= 2}
    text = {(r.conv_id, r.turn): f"{r.text} {['a bolt', 'ring and gear', 'widget', 'none'][r.conv_id % 4]}".lower() for r in turns if r.text is not None}
    want = {(*k, i) for k, t in text.items() for n, i in last.items() if n in t}
    got = QUERIES["evidence"](spark, data).collect()
    assert len(got) == len(want) and {(r.conv_id, r.turn, r.node_id) for r in got} == want
    cited = {k: sum(w[:2] == k for w in want) for k in {w[:2] for w in want}}
    assert {(r.conv_id, r.turn): r.n for r in QUERIES["uncited"](spark, data).collect()} == {k: len(parts) - c for k, c in cited.items()}
    assert {(r.conv_id, r.turn): r.score for r in QUERIES["grounding"](spark, data).collect()} == {k: round(c / len(parts), 3) for k, c in cited.items()}


def test_budget_prefix_over_many_short_texts(spark, tmp_path):
    """More than 500 rows fit, over several ranges of ids."""
    rows = [(3 * i, "" if i % 2 else "x" * (i % 7)) for i in range(9000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run, want = 0, set()
    for i, t in rows:
        run += len(t)
        if run <= 20000:
            want.add(i)
    assert len(want) > 500 and {r.doc_id for r in QUERIES["budget_prefix"](spark, str(tmp_path)).collect()} == want


def test_search_from_all_seeds(spark, data):
    """Every order starts a search, and the expansion goes on to 200 nodes."""
    orders = {f"o{r.o_orderkey}" for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()}
    assert {r.seed for r in QUERIES["bfs_levels"](spark, data).where("level = 0").collect()} == orders
    nations = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    regions = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{data}/nation.parquet").collect()}
    seen, want = set(), {}
    for k in sorted(nations):
        if len(seen) >= 200:
            break
        for level, node in enumerate((f"c{k}", f"n{nations[k]}", f"r{regions[nations[k]]}")):
            if node not in seen:
                seen.add(node)
                want[node] = (k, level)
    assert {r.id: (r.place, r.level) for r in QUERIES["expand_seeds"](spark, data).collect()} == want
