from plumbline.operators import graph as G


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "from_id string, to_id string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def as_dict(df, k="id", v="paths"):
    return {r[k]: r[v] for r in df.collect()}


def test_diamond_counts_two_paths(spark):
    e = edges(spark, ("root", "a"), ("root", "b"), ("a", "d"), ("b", "d"), ("x", "d"))
    n = ids(spark, "root", "a", "b", "d", "x")
    assert as_dict(G.path_counts(n, e, "root")) == {"root": 1, "a": 1, "b": 1, "d": 2, "x": 0}


def test_cycles_share_a_component_and_both_forms_agree(spark):
    pairs = [("root", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("root", "c")]
    e, n = edges(spark, *pairs), ids(spark, "root", "a", "b", "c")
    comp = as_dict(G.scc(n, e), v="component")
    assert comp["a"] == comp["b"] and len(set(comp.values())) == 3
    paths = as_dict(G.path_counts(n, e, "root"))
    assert paths == {"root": 1, "a": 1, "b": 1, "c": 2}
    runs = spark.createDataFrame([("r", a, b, "root") for a, b in pairs], "run_id string, from_id string, to_id string, root string")
    one = G.run_metrics(runs)
    assert as_dict(one) == paths and as_dict(one, v="component") == comp


def test_chained_diamonds_saturate(spark):
    rows = []
    for i in range(20):
        rows += [("r", f"n{i}", f"l{i}", "n0"), ("r", f"n{i}", f"r{i}", "n0"), ("r", f"l{i}", f"n{i + 1}", "n0"), ("r", f"r{i}", f"n{i + 1}", "n0")]
    got = as_dict(G.run_metrics(spark.createDataFrame(rows, "run_id string, from_id string, to_id string, root string")))
    assert got["n20"] == 10_000 and got["n3"] == 8


def test_closure_names_the_bound(spark):
    e = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(5)])
    got = {r["id"]: (r["depth"], r["reason"]) for r in G.closure(e, ids(spark, "n0"), max_depth=3).collect()}
    assert got == {"n0": (0, None), "n1": (1, None), "n2": (2, None), "n3": (3, "bound:depth")}
    full = G.closure(e, ids(spark, "n0"), max_depth=9).collect()
    assert len(full) == 6 and not any(r["reason"] for r in full)
    cyc = G.closure(edges(spark, ("a", "b"), ("b", "a")), ids(spark, "a"), max_depth=9)
    assert {r["id"] for r in cyc.collect()} == {"a", "b"}


def test_introducers_shared_and_exclusive(spark):
    e = edges(spark, ("a", "shared"), ("a", "onlyA"), ("b", "shared"))
    pairs = G.attribution(ids(spark, "a", "b"), ids(spark, "shared", "onlyA"), e)
    got = {r["direct"]: (r["affected"], r["exclusive"]) for r in G.introducers(pairs).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_a_direct_dependency_is_a_wall(spark):
    pairs = G.attribution(ids(spark, "a", "b"), ids(spark, "x"), edges(spark, ("a", "b"), ("b", "x")))
    assert {(r["direct"], r["id"]) for r in pairs.collect()} == {("b", "x")}


def test_greedy_plan_takes_marginal_gain(spark):
    pairs = spark.createDataFrame([("big", "x"), ("big", "y"), ("big", "z"), ("subset", "x"), ("subset", "y"), ("other", "w")], "direct string, id string")
    got = [(r["direct"], r["affected"], r["gain"]) for r in G.greedy_plan(pairs, 2).orderBy("step").collect()]
    assert got == [("big", 3, 3), ("other", 1, 1)]


def test_paths_to_are_simple_and_shortest_first(spark):
    e = edges(spark, ("root", "a"), ("a", "t"), ("root", "t"), ("a", "b"), ("b", "a"), ("b", "t"), ("other", "t"))
    got = [r["path"] for r in G.paths_to(e, "root", "t", 5).collect()]
    assert got == [["root", "t"], ["root", "a", "t"], ["root", "a", "b", "t"]]


def test_upsert_keeps_the_most_complete_then_the_first(spark):
    rows = spark.createDataFrame([("a", "declared", 1, "x"), ("a", "resolved", 2, "y"), ("a", "resolved", 3, "z")], "id string, completeness string, ord int, note string")
    assert [tuple(r) for r in G.upsert_nodes(rows).collect()] == [("a", "resolved", 2, "y")]


def test_induced_subgraph_hangs_orphans_on_the_root(spark):
    e = spark.createDataFrame([("r", "a", "depends_on"), ("a", "b", "depends_on"), ("x", "c", "installs")], "from_id string, to_id string, kind string")
    got = {tuple(r) for r in G.induced_subgraph(e, ids(spark, "a", "b", "c"), "u").collect()}
    assert got == {("a", "b", "depends_on"), ("u", "a", "depends_on"), ("u", "c", "installs")}


def test_whole_queries_leave_no_order_out(spark, tmp_path):
    from plumbline import catalog

    lines = [(order, 1, 10 + order % 3, 1.0 + order % 50) for order in (1, 199, 200, 5000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["formulation_steps_whole"](spark, str(tmp_path)).collect()
    assert {(r["file"], r["step"], r["to_id"]) for r in got} == {(str(o), 1, p) for o, _, p, _ in lines}
    got = catalog.QUERIES["merge_placements_whole"](spark, str(tmp_path)).collect()
    assert {(r["from_id"], r["to_id"]) for r in got} == {(f"pkg:npm/{'a' if q >= 49 else 'root'}{o % 5}", f"pkg:npm/b{p % 7}") for o, _, p, q in lines}


def test_components_of_long_rings_take_few_rounds(spark):
    ring = lambda first: [(f"{first + i:03d}", f"{first + (i + 1) % 100:03d}") for i in range(100)]
    pairs = ring(0) + ring(100) + ring(200) + [("050", "150"), ("150", "400"), ("400", "401"), ("401", "150")]
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    names = sorted({n for pair in pairs for n in pair})
    assert as_dict(G.scc(ids(spark, *names), edges(spark, *pairs), max_rounds=12), v="component") == G._components(names, out)
