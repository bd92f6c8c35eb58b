import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit
from plumbline.sources import caches, corpora, manifest, release
from plumbline.streaming import live


def test_json_and_csv_corpora(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"image_id": "1", "text": "x", "label": 1}, {"image_id": "2", "text": None, "label": 0}]))
    got = corpora.json_lists(spark, {"train": str(tmp_path / "a.json")}).collect()
    assert sorted(tuple(r) for r in got) == [("1", "x", 1, "train"), ("2", "", 0, "train")]
    (tmp_path / "b.csv").write_text('name,text,hate,target,split\n1,"a, b",1,2,train\n2,c,0,NA,test\n3,d,0,,test\n')
    assert sorted(r["y"] for r in corpora.csv_targets(spark, str(tmp_path / "b.csv")).collect()) == [-1, -1, 2]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "t", "label": 1}\n{"id": 2, "text": "u"}\n')
    assert corpora.json_lines(spark, {"dev": str(tmp_path / "c.jsonl")}).count() == 1
    (tmp_path / "h.jsonl").write_text('{"id": "1", "image": "i", "text": "t", "labels": ["odd", "very", "some"]}\n{"id": "2", "image": "i", "text": "t", "labels": ["odd"]}\n')
    got = corpora.two_corpora(spark, {("s", "train"): str(tmp_path / "h.jsonl")}, {"some": 1, "very": 2}).collect()
    assert [(r["id"], r["y"]) for r in got] == [("1", 2)]


def test_tweets_and_maps(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"1": {"tweet_text": "hi @u https://t.co/x", "labels": [0, 2, 2]}, "2": {"tweet_text": "yo", "labels": [0, 1, 2]}}))
    (tmp_path / "train.txt").write_text("1\n2\n")
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("img/1.json", '{"img_text": "shown"}')
        z.writestr("img/x.png", "no")
    members = corpora.zip_members(spark, str(tmp_path / "t.zip"))
    got = {r["id"]: (r["text"], r["y"]) for r in corpora.voted_tweets(spark, str(tmp_path / "gt.json"), {"train": str(tmp_path / "train.txt")}, members).collect()}
    assert got == {"1": ("hi shown", 2), "2": ("yo", -1)}
    (tmp_path / "e.json").write_text(json.dumps({"7": {"lang": "en", "path_memes": "p", "text": "a  b", "labels_task4": ["YES", "NO", "YES"], "labels_task6": [["A"]]}, "8": {"lang": "es", "text": "c", "labels_task4": [], "labels_task6": []}}))
    got = corpora.annotated_map(spark, str(tmp_path / "e.json")).collect()
    assert [(r["id"], r["text"], r["y"]) for r in got] == [("7", "a b", 1)]
    (tmp_path / "t.tsv").write_text("file_name\tText Transcription\n1.jpg\thello\n2.jpg\tyou\n")
    (tmp_path / "l.tsv").write_text("1.jpg\t1\t0\n")
    assert corpora.text_and_labels(spark, str(tmp_path / "t.tsv"), str(tmp_path / "l.tsv"), ["m", "s"]).count() == 1


def test_aliases_caches_seams(spark):
    df = spark.createDataFrame([("1", "x", 0)], " ID string, Caption string, Hate int")
    assert corpora.by_alias(df).columns == ["text", "label", "id"]
    with pytest.raises(ValueError):
        corpora.by_alias(df.select("Caption"))
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, t string")
    assert [r["item_id"] for r in corpora.not_cached(items, items.where("item_id = 1"), ["item_id"]).collect()] == [2]
    assert corpora.only_existing(items.withColumnRenamed("t", "path"), spark.createDataFrame([("a",)], "path string")).count() == 1
    vec = corpora.with_vectors(items, lambda: lambda ts: [[3.0, 4.0] for _ in ts], "t").first()["vec"]
    assert vec == pytest.approx([0.6, 0.8])
    files = spark.createDataFrame([("f", bytearray(b"xy"))], "path string, content binary")
    assert corpora.with_model_text(files, lambda: lambda b: b.decode().upper()).first()["text"] == "XY"


def test_manifest_embeddings_release(spark, tmp_path):
    (tmp_path / "m.csv").write_text("item_id,text,label\n1,a,x\n2,,y\n")
    m = manifest.read_manifest(spark, str(tmp_path / "m.csv")).withColumn("item_id", F.col("item_id").cast("long"))
    assert [r["text"] for r in m.orderBy("item_id").collect()] == ["a", ""]
    np.save(tmp_path / "v.npy", np.eye(2))
    emb = manifest.read_embeddings(spark, [f"e:image={tmp_path / 'v.npy'}"], m)
    assert tuple(manifest.aligned(m, emb).first()) == (2, 2, 0, 0)
    with pytest.raises(ValueError):
        manifest.embedding_spec("e:sound=x")
    (tmp_path / "p.json").write_text('{"title": {"s0": "typed", "s1": "cut"}}')
    assert manifest.read_provenance(spark, str(tmp_path / "p.json")).count() == 2
    assert manifest.label_dim(m, "label").orderBy("code").first()["label"] == "x"
    assert release.file_hashes(spark, str(tmp_path / "m.csv")).first()["bytes"] == (tmp_path / "m.csv").stat().st_size
    items = spark.createDataFrame([(1, "a", "train"), (2, "a", "train")], "item_id long, text string, split string")
    row = release.split_summary(items, "text").first()
    assert (row["n"], row["distinct"], row["duplicates"]) == (2, 1, 1)
    release.save_results(spark.createDataFrame([("a", 1), ("b", 2)], "task string, v int"), str(tmp_path / "r"))
    release.save_results(spark.createDataFrame([("b", 3)], "task string, v int"), str(tmp_path / "r"))
    assert {(r["task"], r["v"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("a", 1), ("b", 3)}


def test_audit_report(spark):
    rows = [(i, f"T{i % 50} words {i}", f"T{i % 50}", "pos" if i % 2 else "neg", ["s0", "s1"][i % 2], "train" if i % 10 < 7 else "val" if i % 10 < 8 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, text string, title string, label string, source string, split string")
    result = audit.run_data_tier(df, audit.AuditSpec("label", ["text", "title"], "split", "source", nulls=3))
    report = audit.markdown(result)
    assert "| D6 | text |" in report and "| D4 | text |" in report and "## Fields by source" in report and audit.to_json(result)
    assert audit.mean_sd([1.0, 3.0], first=True) == "2.000+-1.000 [1.000]"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Ab 1", "s", "2024-01-01 00:00:00"), (2, None, "s", "2024-01-01 00:10:00")], "item_id long, text string, source string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode, expected in (("shapes", live.shape_stream(stream, "text"), "append", 2), ("profiles", live.profile_stream(stream, ["text"], "source"), "complete", 1), ("windows", live.windowed_profile(stream, "text", "t", "source"), "complete", 1)):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == expected


def test_caches_compute_what_they_lack_only(spark, tmp_path):
    """Contents are computed once; a run that is lost keeps its finished pieces; a full cache computes nothing."""
    path, log = str(tmp_path / "cache"), tmp_path / "log"
    log.mkdir()

    def reader(broken=None):
        def make():
            def read(content):
                if content == broken:
                    raise RuntimeError("lost")
                (log / f"{content.decode()}-{len(list(log.iterdir()))}").touch()
                return content.decode().upper()

            return read

        return make

    files = spark.createDataFrame([(f"p{i}", f"c{i % 30}".encode()) for i in range(60)] + [("none", None)], "path string, content binary")
    done = lambda: sorted({f.name.split("-")[0] for f in log.iterdir()})
    with pytest.raises(Exception, match="lost"):
        caches.texts(files, reader(b"c7"), path, pieces=8)
    kept = caches.read(spark, path, spark.createDataFrame([], "key string, text string").schema).count()
    got = {r["path"]: r["text"] for r in caches.texts(files, reader(), path, pieces=8).collect()}
    assert 0 < kept < 30 and len(got) == 61 and got["p7"] == got["p37"] == "C7" and got["none"] == "" and len(done()) == 30
    for f in log.iterdir():
        f.unlink()
    assert caches.texts(files, reader(), path, pieces=8).count() == 61 and done() == []
    assert caches.texts(files.limit(3), reader(), path, force=True).count() == 3 and len(done()) == 3
    items = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, None)], "item_id long, text string")
    encoder = lambda: lambda texts: np.array([[len(t or ""), 1.0] for t in texts])
    vec = {r["item_id"]: r["vec"] for r in caches.vectors(items, encoder, "text", str(tmp_path / "v")).collect()}
    assert vec[1] == vec[3] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and vec[4] == [0.0, 1.0]


def test_archives_by_the_ids_they_hold(spark, tmp_path):
    file = str(tmp_path / "e.npz")
    np.savez(file, ids=np.array(["3", "1", "2", "1"]), vu=np.arange(8.0).reshape(4, 2))
    ids = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    got = {r["item_id"]: r["vec"] for r in manifest.read_embeddings(spark, [f"e:image={file}#vu@ids"], ids).collect()}
    assert got == {3: [0.0, 1.0], 1: [2.0, 3.0], 2: [4.0, 5.0]}
    with pytest.raises(ValueError, match="no vector"):
        manifest.read_embeddings(spark, [f"e:image={file}#vu@ids"], spark.createDataFrame([(9,)], "item_id long")).count()


def test_live_decisions_after_a_stop_equal_the_table(spark, tmp_path):
    """A stream of several batches that fails in the middle and starts again from its checkpoint."""
    from plumbline.plans import symbolic

    rows = symbolic._rows(spark, "/root/testdata/sf0.001").select("item_id", "s", "ln", "fired", "trigger")
    rows.repartition(6, "item_id").write.parquet(str(tmp_path / "in"))
    decision = lambda df: live.decide(df, symbolic._CARD, 0.4).select("item_id", "pred", "state", "suspicion")
    want = sorted(tuple(r) for r in decision(rows).collect())
    seen = []

    def failing(df):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("stopped")
        return decision(df)

    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    with pytest.raises(Exception, match="stopped"):
        live.decide_stream(stream(), out, checkpoint, failing).awaitTermination()
    part = live.decided(spark, out, decision(rows).schema).count()
    assert 0 < part < len(want)
    live.decide_stream(stream(), out, checkpoint, decision).awaitTermination()
    assert sorted(tuple(r) for r in live.decided(spark, out, decision(rows).schema).collect()) == want
    live.decide_stream(stream(), out, checkpoint, decision).awaitTermination()
    assert live.decided(spark, out, decision(rows).schema).count() == len(want)


def test_system_tier_from_the_command_line(spark, tmp_path):
    from plumbline.__main__ import main

    rows = [(i, s, c, i % 2, i % 2 if c == "rich" or i % 5 else 1 - i % 2, i % 2 if i % 5 else 1 - i % 2) for i in range(60) for s in range(3) for c in ("rich", "equal")]
    spark.createDataFrame(rows, "item_id long, seed long, config string, y long, pa long, pb long").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "i.csv").write_text("component,input\nN,image\nP,post\n")
    (tmp_path / "f.csv").write_text("y,pred_full,pred_without\n1,1,0\n0,0,0\n")
    assert main(["system", "--predictions", str(tmp_path / "p.parquet"), "--equal", "equal", "--inventory", str(tmp_path / "i.csv"), "--system", "N", "P", "--baseline", "N", "--available", "image", "post", "--influence", str(tmp_path / "f.csv"), "--out", str(tmp_path / "a")]) == 0
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["meta"] == {"items": 60, "seeds": 3, "classes": 2, "equal": "equal"} and got["S1"]["verdict"] == "FLAG"
    configs = {c["config"]: c for c in got["S2"]["configs"]}
    assert configs["equal"]["margin"] == 0 and configs["rich"]["margin_lo"] > 0 and got["S2"]["verdict"] == "FLAG" and got["S2"]["gains"] == ["rich"]
    assert got["S4"]["n_changed"] == 1 and "verdict" in got["S3"]
    with pytest.raises(ValueError, match="no predictions"):
        main(["system", "--predictions", str(tmp_path / "p.parquet"), "--equal", "other", "--out", str(tmp_path / "b")])
