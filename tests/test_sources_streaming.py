"""Drifting annotation documents, and the correction log as a stream."""

import os
import random

from sparkgauge.operators import series
from sparkgauge.sources.annotations import annotations, images
from sparkgauge.streaming.correction_log import follow, outcomes


def test_layouts_are_chosen_by_fields(spark):
    docs = [
        (1, '{"images":[{"id":7,"width":10,"height":20}],"annotations":[{"image_id":7,"category_id":3,"segmentation":[[1,2,3,4,5,6],[0.5,1]]}]}'),
        (2, '{"images":[{"id":"a","w":10.5,"h":2},{"id":"b","size":[3,4]},{"id":"c"}],"annotations":[{"image_id":"a","label":"x","polygon":[1,2]},{"image_id":"b","bbox":[1,2,10,20]},{"image_id":"c","polygon":"bad"}]}'),
        (3, '{"annotations":[]}'), (4, "{broken"), (5, None), (6, "[1, 2]"), (7, '{"images":[],"annotations":{"a":1}}'),
    ]
    df = spark.createDataFrame([(*x, "x") for x in docs], "k long, j string, width string")
    got = sorted((x.doc, x.image_id, x.width, x.height, x.layout) for x in images(df, "k", "j").collect() if x.image_id)
    assert got == [(1, "7", 10.0, 20.0, "named"), (2, "a", 10.5, 2.0, "short"), (2, "b", 3.0, 4.0, "pair"), (2, "c", None, None, "unsized")]
    rest = {x.doc: x.layout for x in images(df, "k", "j").collect() if not x.image_id}
    assert rest == {3: "empty", 4: "malformed", 5: "malformed", 6: "empty", 7: "empty"}
    marks = {(x.doc, x.pos, x.part): (x.image_id, x.category, x.polygon) for x in annotations(df, "k", "j").collect()}
    assert marks == {
        (1, 0, 0): ("7", "3", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1, 0, 1): ("7", "3", [0.5, 1.0]), (2, 0, 0): ("a", "x", [1.0, 2.0]),
        (2, 1, 0): ("b", None, [1.0, 2.0, 11.0, 2.0, 11.0, 22.0, 1.0, 22.0]), (2, 2, 0): ("c", None, None),
    }
    assert images(df.where("false"), "k", "j").count() == annotations(df.where("false"), "k", "j").count() == 0


def test_stream_equals_batch_also_when_replayed(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"k{r.randrange(12)}" if r.random() < 0.95 else None, i if r.random() < 0.9 else None, r.choice(["ok", "pulada", "invalida", "fechada", "other", None]), round(r.random(), 3) if r.random() < 0.9 else None) for i in range(200)]
    schema = "key string, seq long, status string, v double"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def batch(upto):
        whole = spark.createDataFrame(rows[:upto], schema)
        return sorted(map(str, series.latest(whole, "key", "status", "seq", ["v"]).collect()))

    def stream():
        follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log), "key", "status", "seq", ["v"], out)
        return sorted(map(str, outcomes(spark, "key", out).collect()))

    for at in range(0, 120, 40):
        spark.createDataFrame(rows[at : at + 40], schema).coalesce(1).write.mode("append").parquet(log)
    assert stream() == batch(120)
    spark.createDataFrame(rows[120:], schema).coalesce(1).write.mode("append").parquet(log)
    assert stream() == batch(200) == stream()
    # the last batch runs again: its commit is lost, the sink has it
    last = max(int(n) for n in os.listdir(f"{out}/state/commits") if n.isdigit())
    os.remove(f"{out}/state/commits/{last}")
    for name in (f".{last}.crc",):
        if os.path.exists(f"{out}/state/commits/{name}"):
            os.remove(f"{out}/state/commits/{name}")
    assert stream() == batch(200)


def test_a_box_is_read_once(spark):
    """An entry's box is asked for once, not for each of its corners' numbers."""
    from sparkgauge.sources.annotations import annotations

    docs = spark.createDataFrame([(1, '{"annotations": [{"bbox": [1, 2, 3, 4]}, {"bbox": [1, 2]}, {"polygon": [1, 2, 3]}, {"segmentation": [[5, 6], [7]]}, {}]}')], "id long, json string")
    out = annotations(docs, "id", "json")
    assert [r.polygon for r in out.orderBy("pos", "part").collect()] == [[1, 2, 4, 2, 4, 6, 1, 6], None, [1, 2, 3], [5, 6], [7], None]
    assert out._jdf.queryExecution().analyzed().toString().count("$.bbox") == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("$.annotations") == 1


def test_texts_without_annotations_give_no_rows(spark):
    from sparkgauge.sources.annotations import annotations

    docs = spark.createDataFrame([(1, '{"annotations": []}'), (2, "{"), (3, None), (4, "{}"), (5, '{"annotations": [null]}')], "id long, json string")
    assert [(r.doc, r.pos, r.polygon) for r in annotations(docs, "id", "json").collect()] == [(5, 0, None)]
