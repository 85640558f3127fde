import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from quern.dialect.lexer import QueryError
from quern.functions.stemming import stem
from quern.plans.table import ROW
from quern.procedures import learning
from quern.streaming.continuous import Continuous


def test_bucketize_and_ranking(engine, spark):
    engine.register("s", spark.range(123).select((F.col("id") * 2).alias("score"), F.concat(F.lit("r"), "id").alias(ROW)))
    out = {r[ROW]: r["rank"] for r in engine.run("ranking", inputData="s", orderBy="score").collect()}
    assert out["r0"] == 0 and out["r122"] == 122
    b = engine.run("bucketize", inputData="s", orderBy="score DESC", percentileBuckets={"top": (0, 50), "rest": (50, 100)})
    assert {r["bucket"]: r["count"] for r in b.groupBy("bucket").count().collect()} == {"top": 61, "rest": 62}


def test_summary(engine, spark):
    engine.register("t", spark.createDataFrame([("row1", 1, 2, "x"), ("row2", 10, None, "y"), ("row3", 1, None, None)], f"{ROW} string, colA int, colB int, colTxt string"))
    out = {r["column"]: r for r in engine.run("summary.statistics", inputData="t").collect()}
    a = out["colA"]
    assert (a["first_quartile"], a["median"], a["third_quartile"], a["num_unique"], a["num_null"], a["mean"]) == (1, 1, 10, 2, 0, 4)
    assert math.isnan(out["colB"]["stddev"]) and out["colTxt"]["num_null"] == 1


def test_stats_table(engine, spark):
    engine.register("b", spark.createDataFrame([("br_1", "patate", 1, 1), ("br_2", "carotte", 1, 2), ("br_3", "patate", 0, 3)], f"{ROW} string, host string, click int, t int"))
    out = {r[ROW]: r.asDict() for r in engine.run("statsTable.train", trainingData="b", select="host", outcomes=[("click", "click = 1")], orderBy="t", functionName="counts").collect()}
    assert out["br_1"]["trial-host"] == 0 and out["br_3"]["trial-host"] == 1 and out["br_3"]["click-host"] == 1
    assert engine.apply("counts", keys={"host": "patate"}) == {"counts": {"trial-host": 2, "click-host": 1}}


def test_split_keeps_shares(engine, spark):
    engine.register("l", spark.range(100).select((F.col("id") % 2).alias("y"), F.col("id").cast("string").alias(ROW)))
    a, b = engine.run("split", labels="y", inputData="l", splits=[0.7, 0.3])
    assert a.count() == 70 and b.count() == 30 and a.where("y = 1").count() == 35


def test_tfidf_function(engine, spark):
    engine.register("d", spark.createDataFrame([("1", {"peanut": 1, "butter": 1}), ("2", {"jelly": 1, "butter": 2})], f"{ROW} string, words map<string,bigint>"))
    engine.run("tfidf.train", trainingData="d", functionName="w", idfType="inverse")
    got = engine.apply("w", input={"butter": 2, "jelly": 1})["output"]
    assert got["butter"] == 0 and got["jelly"] == pytest.approx(math.log(2))


def test_learning(engine, spark):
    engine.register("pts", spark.createDataFrame([(str(i), float(i % 2), float(i % 2) * 5, i % 2) for i in range(40)], f"{ROW} string, x double, y double, label int"))
    model = engine.run("classifier.train", trainingData="SELECT {x, y} AS features, label FROM pts", configuration={"type": "glz"}, functionName="clf")
    assert model.mode == "boolean" and engine.apply("clf", features={"x": 1.0, "y": 5.0})["score"] > 0.9
    engine.run("kmeans.train", trainingData="SELECT x, y FROM pts", numClusters=2, metric="euclidean", functionName="km")
    assert engine.apply("km", x=0.0, y=0.0) != engine.apply("km", x=1.0, y=5.0)
    engine.run("svd.train", trainingData="SELECT x, y FROM pts", numSingularValues=1, functionName="sv")
    assert len(engine.apply("sv", x=1.0, y=5.0)["embedding"]) == 1
    assert engine.run("tsne.train", trainingData="SELECT x, y FROM pts", steps=5).count() == 40


def test_forest_grows_all_trees_to_the_depth(engine, spark):
    # bits of i at random places, so that no shallow tree tells the labels apart
    engine.register("deep", spark.createDataFrame([(str(i), float(i), (i * 2654435761 >> 7) % 2) for i in range(600)], f"{ROW} string, x double, label int"))
    data = "SELECT {x} AS features, label FROM deep"
    model = engine.run("randomforest.binary.train", trainingData=data).model
    assert model.getNumTrees == 100 and 12 < max(t.depth for t in model.trees) <= 20
    few = engine.run("randomforest.binary.train", trainingData=data, featureVectorSamplings=2, featureSamplings=3, maxDepth=100).model
    assert few.getNumTrees == 6 and few.getOrDefault("maxDepth") == 30
    assert engine.run("randomforest.binary.train", trainingData=data, featureVectorSamplings=1, featureSamplings=2, maxDepth=4).model.getOrDefault("maxDepth") == 4


def test_neighbors(engine, spark):
    engine.register("e", spark.createDataFrame([("ex1", [0.0, 0.0]), ("ex2", [0.0, 1.0]), ("ex3", [1.0, 0.0]), ("ex4", [1.0, 1.0])], f"{ROW} string, v array<double>"))
    engine.run("embedding.neighbors", dataset="e", functionName="nn")
    got = engine.apply("nn", coords=[0.1, 0.2], numNeighbors=2)
    assert got["neighbors"] == ["ex1", "ex2"]


def test_functions(engine):
    engine.create_function("plus", "sql.expression", expression="x + 1 AS y")
    assert engine.apply("plus", x=2) == {"y": 3}
    engine.create_function("stop", "filter_stopwords")
    assert engine.apply("stop", words={"the": 1, "cat": 2}) == {"words": {"cat": 2}}
    engine.create_function("st", "stemmerdoc")
    assert engine.apply("st", document="running cats") == {"document": "run cat"}
    engine.create_function("ts", "tokensplit", tokens=["$"])
    assert engine.apply("ts", text="5$ and$6") == {"output": "5 $ and $ 6"}
    engine.create_function("h", "feature_hasher", numBits=3)
    assert len(engine.apply("h", a=1, b=2)["hash"]) == 8


def test_statistics_functions(engine, spark):
    engine.register("w", spark.createDataFrame([("1", {"good": 1, "the": 1}, 1), ("2", {"bad": 1, "the": 1}, 0), ("3", {"good": 1}, 1)], f"{ROW} string, words map<string,bigint>, y int"))
    engine.run("statsTable.bagOfWords.train", trainingData="w", select="words", outcomes=[("hit", "y = 1")], outputDataset="st")
    engine.create_function("pn", "statsTable.bagOfWords.posneg", statsTable="st", outcomeToUse="hit", numPosNeg=1, minTrials=1)
    assert engine.apply("pn", words={"good": 1, "the": 1, "bad": 2}) == {"probs": {"good": 1, "bad": 0}}
    engine.create_function("dv", "experimental.statsTable.derivedColumnsGenerator", columns=["host"], expression="hit / trial", outcomes=["hit"], columnId="rate")
    assert engine.apply("dv", counts={"trial-host": 4, "hit-host": 1}) == {"rate-host": 0.25}
    engine.register("lin", spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 1) for i in range(20)], "x double, z double, label double"))
    model = engine.run("classifier.train", trainingData="SELECT {x, z} AS features, label FROM lin", configuration={"type": "glz", "regularization_factor": 0.0}, mode="regression")
    engine.create_function("ex", "classifier.explain", classifier=model)
    got = engine.apply("ex", features={"x": 3.0, "z": 1.0})
    assert got["explanation"]["x"] == pytest.approx(6, abs=1e-3) and got["bias"] == pytest.approx(1, abs=1e-3)


def test_files(engine, spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a,b"\n2,c\n')
    df = engine.run("import.text", dataFileUrl=str(tmp_path / "a.csv"), outputDataset="csv", where="x > 1")
    assert [tuple(r)[:2] for r in df.collect()] == [(2, "c")]
    (tmp_path / "b.txt").write_text("one\ntwo\nthree\n")
    lines = engine.run("import.text", dataFileUrl=str(tmp_path / "b.txt"), delimiter="", offset=1, limit=1)
    assert [r["lineText"] for r in lines.collect()] == ["two"]
    (tmp_path / "c.json").write_text('{"a":1,"b":{"c":"x"}}\n{"a":2}\n')
    got = engine.run("import.json", dataFileUrl=str(tmp_path / "c.json"), outputDataset="js")
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(1, "x"), (2, None)]
    out = engine.run("export.csv", exportData="SELECT a FROM js ORDER BY a", dataFileUrl=str(tmp_path / "out"), singleFile=True)
    assert spark.read.csv(out, header=True).count() == 2
    assert engine.run("list.files", path=str(tmp_path), maxDepth=0).count() == 3


def test_continuous(engine, spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select id, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) as ts from range(10)").write.parquet(str(src))
    c = Continuous(engine, str(tmp_path / "c"))
    c.record(spark.readStream.schema("id bigint, ts timestamp").parquet(str(src))).awaitTermination(60)
    assert c.manifest().count() == 10
    assert c.window("2024-01-03", "2024-01-05", "w").count() == 3
    assert engine.sql("SELECT count(*) AS n FROM w").first()[0] == 3


def test_permuter_and_serial(engine, spark):
    engine.register("n", spark.range(3))
    out = engine.run("permuter.run", procedure={"type": "transform", "params": {"inputData": "n"}}, permutations={"outputDataset": ["p1", "p2"]})
    assert len(out) == 2 and engine.table("p2").df.count() == 3
    assert len(engine.run("serial", steps=[{"type": "null"}, {"type": "transform", "params": {"inputData": "SELECT id FROM n"}}])) == 2


def test_models_as_functions_of_columns(engine, spark):
    """Every row gets its own score, that of the model's batch prediction."""
    engine.register("cols", spark.createDataFrame([(str(i), float(i), i >= 50, "abc"[i // 34]) for i in range(100)], f"{ROW} string, x double, hit boolean, kind string"))
    for kind in ("decision_tree", "bagging", "boosting", "naive_bayes", "glz", "onevsall"):
        model = engine.run("classifier.train", trainingData="SELECT {x} AS features, kind AS label FROM cols", functionName="f", configuration={"type": kind}, mode="categorical")
        got = {r["x"]: [r["s.a"], r["s.b"], r["s.c"]] for r in engine.sql("SELECT x, f({features: {x}})[scores] AS s FROM cols").collect()}
        _, df, _ = learning._training(engine, "SELECT {x} AS features, kind AS label, x AS x FROM cols")
        for r in model.score(df).select("x", "score").collect():
            assert got[r["x"]] == pytest.approx([r["score"][k] for k in "abc"], abs=1e-6), kind
    engine.run("classifier.train", trainingData="SELECT {x} AS features, hit AS label FROM cols", functionName="t", configuration={"type": "decision_tree"})
    assert {r["x"]: r["s"] for r in engine.sql("SELECT x, t({features: {x}})[score] AS s FROM cols").collect()} == {float(i): float(i >= 50) for i in range(100)}


def test_neighbors_of_each_row(engine, spark):
    engine.register("line", spark.createDataFrame([(str(i), [float(i), 0.0]) for i in range(5)] + [("none", None)], f"{ROW} string, v array<double>"))
    engine.run("embedding.neighbors", dataset="line", functionName="nn", numNeighbors=2)
    got = [tuple(r) for r in engine.sql("SELECT rowName() AS k, nn({coords: v})[neighbors] AS n FROM line").collect()]
    assert sorted(got, key=str) == sorted([("0", ["0", "1"]), ("1", ["1", "0"]), ("2", ["2", "1"]), ("3", ["3", "2"]), ("4", ["4", "3"]), ("none", None)], key=str)


def test_rolling_sums_of_a_frequent_key(engine, spark):
    engine.register("hot", spark.range(500).selectExpr("cast(id as string) as `_rowName`", "if(id % 50 = 0, null, if(id % 10 = 0, 'rare', 'often')) as k", "id as t"))
    out = engine.run("statsTable.train", trainingData="SELECT k, t FROM hot", select="k", outcomes=[("even", "t % 2 = 0")], orderBy="t")
    seen = {}
    want = {}
    for i in range(500):
        k = None if i % 50 == 0 else "rare" if i % 10 == 0 else "often"
        n, e = seen.get(k, (0, 0))
        want[str(i)] = (n, e)
        seen[k] = (n + 1, e + (i % 2 == 0))
    assert {r[ROW]: (r["trial-k"], r["even-k"]) for r in out.collect()} == want


def test_lines_are_numbered_in_the_order_of_files(engine, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(3)))
    (tmp_path / "b.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(100, 5000)))
    out = engine.run("import.json", dataFileUrl=str(tmp_path), limit=4)
    assert sorted(r["a"] for r in out.collect()) == [0, 1, 2, 100]


def test_what_a_text_file_tells(engine, tmp_path):
    """Names of lines count the header and what comes before it, not what is skipped by pattern."""
    (tmp_path / "a.csv").write_text("# made up\nx,y\n1,a\n2,b\n3,c\n")
    get = lambda **more: [tuple(r) for r in engine.run("import.text", dataFileUrl=str(tmp_path / "a.csv"), preHeaderOffset=1, select="x, lineNumber() AS n, lineOffset() AS o, dataFileUrl() AS u, fileTimestamp() IS TIMESTAMP AS t", named="'r' + lineNumber()", **more).orderBy("x").collect()]
    url = str(tmp_path / "a.csv")
    assert get() == [(1, 3, 0, url, True, "r3"), (2, 4, 0, url, True, "r4"), (3, 5, 0, url, True, "r5")]
    assert [r[0] for r in get(offset=1, limit=1)] == [2]
    (tmp_path / "b.csv").write_text("1,2.5\n\n7,x\n")
    df = engine.run("import.text", dataFileUrl=str(tmp_path / "b.csv"), headers=["i", "s"], outputDataset="b")
    assert df.dtypes[:2] == [("i", "int"), ("s", "string")] and [r[ROW] for r in df.orderBy("i").collect()][0] == "1"
    (tmp_path / "c.csv").write_text("skip me\ni,s,v\n1,2.5,\n7,3,\n")
    df = engine.run("import.text", dataFileUrl=str(tmp_path / "c.csv"), skipLineRegex="skip.*")
    assert dict(df.dtypes) == {"i": "int", "s": "double", "v": "string", ROW: "string"} and sorted(tuple(r)[:3] for r in df.collect()) == [(1, 2.5, None), (7, 3.0, None)]
    (tmp_path / "d.csv").write_text("skip me\ni,s\n1,2\n7\n")
    assert engine.run("import.text", dataFileUrl=str(tmp_path / "d.csv"), skipLineRegex="skip.*", ignoreBadLines=True).count() == 1
    with pytest.raises(Exception, match="number of fields"):
        engine.run("import.text", dataFileUrl=str(tmp_path / "d.csv"), skipLineRegex="skip.*").collect()
    (tmp_path / "e.txt").write_text("")
    assert engine.run("import.text", dataFileUrl=str(tmp_path / "e.txt"), skipLineRegex="x").count() == 0


def test_vectors_in_the_binary_format(engine, tmp_path):
    words = {"sun": [1.5, -2.0, 0.25], "rain": [3.0, 4.0, 5.0], "wind": [0.0, 1e10, -7.5]}
    (tmp_path / "v.bin").write_bytes(b"3 3\n" + b"".join(w.encode() + b" " + np.array(v, "<f4").tobytes() + b"\n" for w, v in words.items()))
    out = engine.run("import.word2vec", dataFileUrl=str(tmp_path / "v.bin"), outputDataset="vec")
    assert {r[ROW]: r["vector"] for r in out.collect()} == words
    assert [r[ROW] for r in engine.run("import.word2vec", dataFileUrl=str(tmp_path / "v.bin"), offset=1, limit=1, binary=True).collect()] == ["rain"]
    (tmp_path / "v.txt").write_text("2 2\na 1 2\nb 3 4.5\n")
    assert {r[ROW]: r["vector"] for r in engine.run("import.word2vec", dataFileUrl=str(tmp_path / "v.txt"), named="upper(word)").collect()} == {"A": [1.0, 2.0], "B": [3.0, 4.5]}


def test_statistics_of_all_rows(engine, spark):
    engine.register("bids", spark.createDataFrame([("a.com", 1.0, 1), ("b.com", 2.0, 2), ("a.com", 9.0, 3), (None, 4.0, 4)], "host string, price double, t int"))
    for order, last in (("t", 9.0), ("t DESC", 1.0)):
        engine.run("experimental.distTable.train", trainingData="SELECT host, price, t FROM bids", select="host", outcomes=[("price", "price")], statistics=("count", "avg", "std", "min", "max", "last"), functionName="get", orderBy=order)
        got = engine.apply("get", features={"host": "a.com"})["stats"]
        assert list(got.values()) == pytest.approx([2, 5.0, 32**0.5, 1.0, 9.0, last]) and list(got)[0] == "price.host.count"
    got = engine.apply("get", features={"host": "none", "other": 1})["stats"]
    assert got["price.host.count"] == 0 and math.isnan(got["price.host.avg"]) and len(got) == 6
    rows = engine.sql("SELECT t, get({features: {host}})[stats] AS s FROM bids").orderBy("t").collect()
    assert [r["s.price.host.count"] for r in rows] == [2, 1, 2, 1]


def test_counts_of_many_values(engine, spark):
    engine.register("many", spark.range(12_000).selectExpr("cast(id % 6000 as string) as k", "id"))
    engine.run("statsTable.train", trainingData="SELECT k, id FROM many", select="k", outcomes=[("low", "id < 6000")], functionName="counts", orderBy="id")
    got = engine.sql("SELECT counts({keys: {k}})[counts] AS c FROM many").groupBy("`c.trial-k`", "`c.low-k`").count().collect()
    assert [tuple(r) for r in got] == [(2, 1, 12_000)]


def test_links(engine, spark):
    """Each link's function of columns gives the model's own chances; the curve of a probabilizer rises."""
    rows = [(str(i), i / 40 - 1, bool((i * 7) % 80 < i)) for i in range(80)]
    engine.register("curve", spark.createDataFrame(rows, f"{ROW} string, x double, hit boolean"))
    seen = set()
    for link in ("logit", "probit", "comp_log_log", "linear"):
        model = engine.run("classifier.train", trainingData="SELECT {x} AS features, hit AS label FROM curve", functionName="f", configuration={"type": "glz", "link_function": link})
        got = {r["x"]: r["s"] for r in engine.sql("SELECT x, f({features: {x}})[score] AS s FROM curve").collect()}
        _, df, _ = learning._training(engine, "SELECT {x} AS features, hit AS label, x AS x FROM curve")
        for r in model.score(df).select("x", "score").collect():
            assert got[r["x"]] == pytest.approx(r["score"], abs=1e-6), link
        assert got[max(got)] > got[0.0] > got[-1.0]
        seen.add(round(got[-1.0], 6))
    assert len(seen) == 4
    for link in ("logit", "probit"):
        engine.run("probabilizer.train", trainingData="SELECT x AS score, hit AS label FROM curve", functionName="p", link=link)
        assert 0 < engine.apply("p", score=-1.0)["prob"] < 0.2 < 0.8 < engine.apply("p", score=1.0)["prob"] < 1
    with pytest.raises(QueryError):
        engine.run("classifier.train", trainingData="SELECT {x} AS features, hit AS label FROM curve", configuration={"type": "glz", "link_function": "cube"})


# fixed values: words and stems of the algorithm's published sample
STEMS = """consign consign consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolidate consolid consolingly consol conspicuous conspicu conspiracy conspiraci
constable constabl constancy constanc knackeries knackeri knaves knave knavish knavish knightly knight knitted knit knives knive knotty knotti generically generic communication communic hopping hop hoping hope
cries cri ties tie gas gas this this gaps gap kiwis kiwi dying die skies sky news news relational relat agreed agre feed feed controlling control boyish boyish say say innings inning luxuriated luxuri dog's dog""".split()


def test_stems(engine):
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert [stem(w) for w in ("", "a", "is", "ing", "éé", "'", "I", "Yes")] == ["", "a", "is", "ing", "éé", "'", "I", "Yes"]
    engine.create_function("st", "stemmer", language="english")
    assert engine.apply("st", words={"lamp": 2, "lamps": 3, "none": None})["words"] == {"lamp": 5}
    assert engine.sql("SELECT st({words: {false AS lamp, 3 AS lamps, true AS tree, 'x' AS trees}})[words] AS w").first()[0] == {"lamp": 3, "tree": 2}
    engine.create_function("sd", "stemmerdoc")
    assert engine.apply("sd", document="We were hoping for trees")["document"] == "We were hope for tree"
    with pytest.raises(QueryError):
        engine.create_function("fr", "stemmer", language="klingon")


def test_user_agents(engine, spark, tmp_path):
    phone = "Mozilla/5.0 (iPhone; CPU iPhone OS 12_4 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/12.1.2 Mobile/15E148 Safari/604.1"
    want = {"browser": {"family": "Mobile Safari", "version": "12.1.2"}, "os": {"family": "iOS", "version": "12.4.0"}, "device": {"brand": "Apple", "model": "iPhone"}, "isSpider": 0}
    engine.create_function("ua", "http.useragent")
    assert engine.apply("ua", ua=phone) == want
    assert engine.apply("ua", ua="Mozilla/5.0 (compatible; Googlebot/2.1)")["isSpider"] == 1 and engine.apply("ua", ua="")["browser"] == {"family": "Other", "version": "0.0.0"}
    rules = """
user_agent_parsers:
  - regex: '(Made)Up/(\\d+)\\.(\\d+)'
    family_replacement: '$1 up'
os_parsers:
  - regex: 'toaster'
    os_replacement: 'Bread'
    os_v1_replacement: '7'
device_parsers:
  - regex: 'TOASTER ([a-z]+)'
    regex_flag: 'i'
    device_replacement: 'Spider'
    brand_replacement: 'Acme'
    model_replacement: 'T $1'
"""
    (tmp_path / "r.yaml").write_text(rules)
    engine.create_function("own", "http.useragent", regexFile=str(tmp_path / "r.yaml"))
    assert engine.apply("own", ua="MadeUp/3.4 (toaster x)") == {"browser": {"family": "Made up", "version": "3.4.0"}, "os": {"family": "Bread", "version": "7.0.0"}, "device": {"brand": "Acme", "model": "T x"}, "isSpider": 1}
    engine.register("agents", spark.createDataFrame([(1, phone), (2, None), (3, phone)], "i int, a string"))
    assert [r[1] for r in engine.sql("SELECT i, ua({ua: a})[browser][family] AS f FROM agents").orderBy("i").collect()] == ["Mobile Safari", None, "Mobile Safari"]


def test_neighbors_of_more_vectors_than_a_slice(engine, spark, monkeypatch):
    from quern.procedures import scoring

    monkeypatch.setattr(scoring, "SENT", 4096, raising=False)
    monkeypatch.setattr(scoring, "SLICE", 4096, raising=False)
    x = np.random.default_rng(5).normal(size=(300, 4))
    x[100:200] = x[7]
    rows = [(f"n{i:03}", v.tolist()) for i, v in enumerate(x)] + [("odd", [float("nan"), 0.0, 0.0, 0.0]), ("far", [1e200, 0.0, 0.0, 0.0])]
    engine.register("wide", spark.createDataFrame(rows, f"{ROW} string, v array<double>").repartition(3))
    engine.run("embedding.neighbors", dataset="wide", functionName="nn", numNeighbors=3)
    got = {r["k"]: (r["n"], r["d"]) for r in engine.sql("SELECT rowName() AS k, nn({coords: v})[neighbors] AS n, nn({coords: v})[distances] AS d FROM wide").collect()}
    assert got["odd"] == ([], []) and got["far"][0] == ["far", "n000", "n001"]
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        want = sorted(range(300), key=lambda j: (d[j], j))[:3]
        assert got[f"n{i:03}"] == ([f"n{j:03}" for j in want], [d[j] for j in want])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bags_of_words_need_no_python(engine, spark):
    from collections import Counter

    texts = ["", " ", "b a b", "é a É é  a", None, " ".join(f"w{i * i % 977}" for i in range(5000))]
    engine.register("txt", spark.createDataFrame([(str(i), t, i % 2) for i, t in enumerate(texts)], f"{ROW} string, text string, y int"))
    bags = engine.query("SELECT tokenize(text, {splitChars: ' '}) AS t FROM txt").df
    assert "Python" not in _plan(bags)
    assert [r["t"] for r in bags.orderBy(ROW).collect()] == [None if t is None else dict(Counter(w for w in t.split(" ") if w)) for t in texts]
    out = engine.run("statsTable.bagOfWords.train", trainingData="txt", select="tokenize(text, {splitChars: ' '}) AS t", outcomes=[("odd", "y = 1")])
    assert "Python" not in _plan(out)
    got = {r["word"]: (r["trial"], r["odd"]) for r in out.collect()}
    assert got["a"] == (2, 1) and got["é"] == (1, 1) and got["w0"] == (1, 1)


def test_quoted_tokens_need_no_python(engine, spark):
    from collections import Counter

    def tokens(s, chars, quote):
        out, part, inside = [], [], False
        for ch in s:
            if ch in quote:
                inside = not inside
            elif ch in chars and not inside:
                out.append("".join(part))
                part = []
            else:
                part.append(ch)
        return [*out, "".join(part)]

    draw = np.random.default_rng(7)
    texts = ["", '"', '""', ',"', 'a,"b,c"', 'a"b,c"d,"e', ",,", None, '"' * 20001, "a," * 20000]
    texts += ["".join(draw.choice(list("ab,;^]-\\'\"é😀\n\x01"), draw.integers(1, 60))) for _ in range(300)]
    engine.register("txt", spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], f"{ROW} string, text string"))
    for chars, quote in ((",", '"'), (",;^]-", '"'), ("\\é", '"😀'), ("a,", ",b"), ("", '"')):
        options = {"chars": chars, "quote": quote}
        got = engine.query("SELECT tokenize(text, {splitChars: $chars, quoteChar: $quote}) AS t, token_extract(text, 1, {splitChars: $chars, quoteChar: $quote}) AS w FROM txt", **options).df
        assert "Python" not in _plan(got)
        for t, r in zip(texts, got.orderBy(ROW).collect(), strict=True):
            words = None if t is None else [w for w in tokens(t, chars, quote) if w]
            assert r["t"] == (None if t is None else dict(Counter(words))), (t, chars, quote)
            assert r["w"] == (words[1] if words and len(words) > 1 else None), (t, chars, quote)


def test_nearest_to_a_table_of_queries(spark):
    x = np.random.default_rng(6).normal(size=(300, 4)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [None, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    for metric in ("euclidean", "cosine"):
        found = learning.nearest(v, "id", "v", v.where("id % 10 = 0"), 3, metric=metric, block=7)
        assert "MapInArrow" in _plan(found)
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["id"], r["distance"]))
        for i in range(0, 300, 10):
            a, b = x.astype(float), x[i].astype(float)
            d = np.sqrt(((a - b) ** 2).sum(1)) if metric == "euclidean" else 1 - (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))
            assert got[i] == [(j, d[j]) for j in sorted(range(300), key=lambda j: (d[j], j))[:3]]
        assert got[300] == [(0, None), (1, None), (2, None)]
    few = v.where("id >= 299")
    assert [(r["query"], r["id"]) for r in learning.nearest(few, "id", "v", few.where("id = 299"), 3).orderBy("rank").collect()] == [(299, 299), (299, 300), (299, 301)]
    assert {(r["query"], r["id"]) for r in learning.nearest(v, "id", "v", v.where("id in (3, 300)"), 5, 1e-9).collect()} == {(3, 3)}
    assert learning.nearest(v, "id", "v", v.where("false"), 3, 1.0).count() == 0


def test_equal_words_are_stemmed_once(engine, spark):
    import pyarrow as pa

    from quern.functions import prepared

    prepared._stem.cache_clear()
    assert prepared._stem_text.func(pa.array(["cats", None, "running cats"] * 1000)).to_pylist() == ["cat", None, "run cat"] * 1000
    info = prepared._stem.cache_info()
    assert (info.misses, info.hits) == (2, 1)
    engine.register("bags", spark.createDataFrame([("1", {"cats": 2, "cat": 1, "runs": None}), ("2", None), ("3", {}), ("4", {"hoping": 1})], f"{ROW} string, b map<string,bigint>"))
    engine.create_function("st", "stemmer")
    assert [r["s"] for r in engine.query("SELECT st({words: b})[words] AS s FROM bags").df.orderBy(ROW).collect()] == [{"cat": 3}, None, {}, {"hope": 1}]
