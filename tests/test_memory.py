"""Memory gates and the bank: cases with known answers, a plain replay, and the stream against the batch."""

from difflib import SequenceMatcher

import pytest

from reelmill.operators import memory
from reelmill.operators.memory import Gates, Memory
from reelmill.plans.memory import candidates

SCHEMA = "dataset string, sequence string, frame_id int, kind string, source string, status string, presence string, identity string, box struct<x:double,y:double,w:double,h:double>, text string, event string"


def positive(frame, **changes):
    return {"frame_id": frame, "kind": "positive", "source": "vlm_prediction", "status": "ok", "presence": "present", "identity": "same", "box": {"x": 10.0, "y": 10.0, "w": 20.0, "h": 20.0}, "text": "", "event": None} | changes


def said(frame, text, **changes):
    return positive(frame, kind="semantic", box=None, text=text) | changes


def run(gates, *steps):
    m = Memory.new(gates)
    return [(r["accepted"], r["reason"], r["confirmations"]) for r in map(m.take, steps)], m


def test_positive_records_need_two_in_a_row():
    made, m = run(Gates(), positive(1), positive(2))
    assert [a for a, *_ in made] == [False, True] and m.bank.recent(4) == [2]


def test_errors_and_strangers_break_a_streak():
    for broken in (positive(2, status="model_error"), positive(2, presence="absent"), positive(2, identity="different"), positive(2, box=None), positive(2, presence=None)):
        made, m = run(Gates(), positive(1), broken, positive(3), positive(4))
        assert [a for a, *_ in made] == [False, False, False, True], broken
    made, _ = run(Gates(), positive(1), positive(32), positive(62))
    assert [a for a, *_ in made] == [False, False, True]  # 31 frames are too many, 30 are not


def test_boxes_that_stray_begin_a_new_streak():
    far = positive(2, box={"x": 90.0, "y": 10.0, "w": 20.0, "h": 20.0})
    assert [a for a, *_ in run(Gates(iou=0.3), positive(1), far, far | {"frame_id": 3})[0]] == [False, False, True]


def test_texts_are_deduplicated_and_cool_down():
    gates = Gates(text_confirmations=2)
    made, m = run(
        gates, said(1, "Rear view reveals two white stripes."), said(2, "Rear view reveals two stable white stripes."), said(10, "The target now carries a red bag."),
        said(40, " rear VIEW reveals  two STABLE WHITE stripes. "), said(40, "The target now carries a red bag."), said(41, "Target now carries the same red bag."),
    )
    assert [r for _, r, _ in made] == ["text_unconfirmed", "accepted", "text_too_soon", "text_held_already", "text_unconfirmed", "accepted"]
    assert [r[2] for r in m.bank.held["semantic"]] == ["Rear view reveals two stable white stripes.", "Target now carries the same red bag."]


def test_an_unrelated_text_confirms_nothing():
    made, m = run(Gates(text_confirmations=2), said(1, "Rear view reveals two white stripes."), said(2, "The target now carries a red bag."))
    assert made[1] == (False, "text_unconfirmed", 1) and not m.bank.held["semantic"]


def test_texts_have_a_window_of_their_own():
    stripes = "Rear view reveals two {}white stripes."
    made, _ = run(Gates(text_confirmations=2), said(10, stripes.format("")), said(100, stripes.format("stable ")))
    assert made[1] == (True, "accepted", 2)
    made, _ = run(Gates(text_confirmations=2), said(10, stripes.format("")), said(311, stripes.format("stable ")))
    assert made[1][0] is False


@pytest.mark.parametrize("text", ["no change in appearance or configuration", "The target is unchanged.", "没有明显外观变化", "无需更新"])
def test_texts_that_say_nothing_count_as_null(text):
    assert run(Gates(), said(1, text))[0][0][1] == "says_no_change"


def test_transitions_count_at_once():
    gone = said(1, "The initialized target is currently absent.", presence="absent", identity="not_applicable", event="disappearance")
    back = said(2, "The initialized target has reappeared with its rear stripes visible.", event="reappearance")
    made, m = run(Gates(text_confirmations=2), gone, back)
    assert [a for a, *_ in made] == [True, True] and len(m.bank.held["semantic"]) == 2
    made, _ = run(Gates(), said(2, "The initialized target remains absent.", presence="absent", event="continued_absence"))
    assert made[0][:2] == (False, "absent_without_disappearance")


def test_banks_drive_out_the_earliest_and_refuse_repeats():
    bank = memory.Bank(Gates(positive_room=2, negative_room=0))
    assert [bank.add("positive", (f, f"r{f}", "")) for f in (5, 3, 9)] == [None, None, "r3"] and bank.recent(1) == [9]
    assert bank.add("negative", (1, "n", "")) == "n"
    with pytest.raises(ValueError, match="held"):
        bank.add("semantic", (9, "r9", ""))


def plain_replay(rows, g):
    """The gates from histories instead of counters: streaks are counted back through all earlier rows."""
    kept, out, texts_at, positives_at, n = {"positive": [], "negative": [], "semantic": []}, [], [], [], 0
    low = lambda t: " ".join((t or "").casefold().split())
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    chain, pend = [], []  # positive candidates, and texts, that follow one another up to here

    def overlap(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    for r in rows:
        f, kind, ok = r["frame_id"], r["kind"], r["status"] == "ok"
        take = False
        room = {"positive": g.positive_room, "negative": g.negative_room, "semantic": g.semantic_room}[kind]
        turn = r["event"] in ("disappearance", "reappearance")
        if kind == "semantic" and r["presence"] == "absent" and r["event"] != "disappearance":
            pend = []
        elif kind == "semantic" and any(low(t) == low(r["text"]) for _, _, t in kept["semantic"]):
            pass
        elif kind == "semantic" and not turn and texts_at and f - texts_at[-1] < g.text_cooldown:
            pass
        elif not ok:
            chain, pend = [], []
        elif kind == "negative":
            take = r["identity"] == "different"
        elif kind == "semantic":
            same = r["presence"] == "absent" or (r["presence"] == "present" and r["identity"] == "same")
            if not same or not low(r["text"]) or "no significant change" in low(r["text"]):
                pend = []
            else:
                follows = pend and 0 < f - pend[-1][0] <= g.text_gap and ratio(low(pend[-1][1]), low(r["text"])) >= g.text_similarity
                pend = [*(pend if follows else []), (f, r["text"])]
                take = len(pend) >= (1 if turn else g.text_confirmations)
                pend = [] if take else pend
        elif r["presence"] != "present" or r["identity"] != "same" or not r["box"]:
            chain, pend = [], []
        else:
            box = [r["box"][k] for k in "xywh"]
            follows = chain and 0 < f - chain[-1][0] <= g.gap and (not g.iou or overlap(box, chain[-1][1]) >= g.iou)
            chain = [*(chain if follows else []), (f, box)]
            take = len(chain) >= g.confirmations and (not positives_at or f - positives_at[-1] >= g.positive_cooldown)
            positives_at += [f] * take
        if take:
            n += 1
            kept[kind].append((f, f"{kind}-{f:08d}-{n:06d}", (r["text"] or "").strip()))
            kept[kind] = sorted(kept[kind])[-room:]
            texts_at += [f] * (kind == "semantic")
        out.append((f, kind, take, sorted(x[0] for x in kept["positive"])[-g.recent :], [x[2] for x in kept["semantic"]], len(kept["negative"])))
    return out


@pytest.mark.parametrize("gates", [Gates(), Gates(iou=0.05, text_confirmations=2, text_cooldown=10, positive_room=3, negative_room=2, semantic_room=2)])
def test_fold_is_a_plain_replay(spark, sf_dir, gates):
    rows = candidates(spark, sf_dir).where("sequence < 'u3'").cache()
    by_key = {}
    for r in rows.collect():
        by_key.setdefault((r.dataset, r.sequence), []).append(r.asDict(recursive=True))
    got = {}
    for r in memory.replayed(rows.repartition(7), gates).collect():
        got.setdefault((r.dataset, r.sequence), []).append((r.frame_id, r.kind, r.accepted, r.recent, r.texts, r.n_negative))
    assert len(by_key) > 5 and any(t[2] for own in got.values() for t in own)
    for key, own in by_key.items():
        assert sorted(got[key]) == sorted(plain_replay(sorted(own, key=lambda r: r["frame_id"]), gates)), key


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert memory.replayed(none).count() == 0
    nulls = spark.createDataFrame([(None, None, 0, "positive", None, None, None, None, None, None, None), ("d", "s", 0, "semantic", None, "ok", "present", "same", None, None, None)], SCHEMA)
    assert {r.reason for r in memory.replayed(nulls).collect()} == {"execution_not_ok", "empty_text"}


def test_memory_of_a_stream_is_that_of_the_batch(spark, sf_dir, tmp_path):
    from reelmill.streaming.replay import memories

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    some = candidates(spark, sf_dir).where("sequence in ('u1', 'u2', 'u3')").cache()
    some.where("frame_id < 30").write.parquet(str(tmp_path / "in" / "a"))
    some.where("frame_id >= 30").write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(some.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gates = Gates(iou=0.05, text_confirmations=2, text_cooldown=10)
    query = memories(stream, gates).writeStream.format("memory").queryName("memories").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.sequence, r.frame_id, r.kind): r for r in memory.replayed(some, gates).collect()}
    streamed = {(r.sequence, r.frame_id, r.kind): r for r in spark.table("memories").collect()}
    assert streamed and all(batch[k].asDict() == v.asDict() for k, v in streamed.items())
