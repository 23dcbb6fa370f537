"""The online loop: folds against plain loops, and the stream against the batch."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from reelmill.operators import packing, replay
from reelmill.operators.evaluation import KEY
from reelmill.sources.fixtures import frames


def test_state_machine_in_batch_and_stream(spark, sf_dir, tmp_path):
    from reelmill.streaming.replay import phases

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    some = frames(spark, sf_dir).where("sequence in ('u1', 'u2', 'u3')").cache()
    some.where("frame_id < 30").write.parquet(str(tmp_path / "in" / "a"))
    some.where("frame_id >= 30").write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(some.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = phases(stream).writeStream.format("memory").queryName("phases").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.sequence, r.frame_id): tuple(r)[3:] for r in replay.cognitive_state(some).collect()}
    streamed = {(r.sequence, r.frame_id): tuple(r)[3:] for r in spark.table("phases").collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())


def test_gated_updates(spark):
    rows = [("d", "s", f, e) for f, e in [(0, True), (3, True), (5, True), (6, True), (9, True), (10, False), (12, True), (50, True), (60, True)]]
    got = {r.frame_id: r.accepted for r in replay.gated_updates(spark.createDataFrame(rows, "dataset string, sequence string, frame_id int, eligible boolean")).collect()}
    assert [f for f in sorted(got) if got[f]] == [3, 9, 60]


def test_verifier_replay(spark):
    rows = [("d", "s", 0, "state b", True, "state a"), ("d", "s", 1, "state c", False, "state a"), ("d", "s", 2, "State b.", True, "state a"), ("d", "s", 3, "state d", True, "state a")]
    got = replay.verifier_replay(spark.createDataFrame(rows, "dataset string, sequence string, frame_id int, update string, accept boolean, initial string")).orderBy("frame_id").collect()
    assert [(r.input_state, r.verdict) for r in got] == [("state a", "accepted"), ("state b", "rejected"), ("state b", "vacuous"), ("state b", "accepted")]


def test_label_chain_asks_in_order(spark):
    rows = [("d", "s", i, "absent" if i == 1 else "present", f"p{i}") for i in range(4)]
    got = replay.label_chain(spark.createDataFrame(rows, "dataset string, sequence string, frame_id int, status string, prompt string"), lambda prompt, state: None if prompt == "p2" else f"{state}>{prompt}")
    assert [(r.input_state, r.memory_update) for r in got.orderBy("frame_id").collect()] == [("", ">p0"), (">p0", None), (">p0", None), (">p0", ">p0>p3")]


def test_similarity(spark):
    rows = [("A man  walks", "a man runs"), ("", "x"), (None, None), ("same", "Same")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(replay.similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "a man walks", "a man runs").ratio(), 0.0, 0.0, 1.0]


def test_packing(spark):
    rows = [("g", f"k{i}", s) for i, s in enumerate([5, 4, 3, 20, 1, 9])]
    got = packing.shard_packing(spark.createDataFrame(rows, "g string, k string, size int"), "k", ("g",), "size", 10)
    assert [r.shard for r in got.orderBy("k").collect()] == [0, 0, 1, 2, 3, 3]


def test_rates_of_a_stream(spark, sf_dir, tmp_path):
    from reelmill.streaming.replay import event_rates

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = event_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == total
    assert KEY == ("dataset", "sequence")


def test_similar_pairs_are_those_of_all_ratios(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cdß\u00a0é") for _ in range(rng.randrange(0, 25))) for _ in range(60)] + [None, "STRASSE", "straße"]
    rows = [(i, rng.choice(texts), rng.choice(texts)) for i in range(400)]
    flat = lambda x: " ".join((x or "").casefold().split())
    for least in (0.3, 0.7):
        want = {i: SequenceMatcher(None, flat(a), flat(b)).ratio() for i, a, b in rows if flat(a) and flat(b)}
        got = replay.similar_pairs(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", least).collect()
        assert {r.i: r.ratio for r in got} == {i: x for i, x in want.items() if x >= least}
