import random

import numpy as np
import pytest

from serixa.operators.codecs import container
from serixa.streaming import processors

SCHEMA = "key long, seq long, data binary, last boolean"


@pytest.mark.parametrize("size", [1, 17])
def test_stream_of_slices_across_batches(spark, tmp_path, size):
    r = random.Random(size)
    data = {k: np.cumsum([r.randint(-9, 9) for _ in range(20 + 50 * k)]).astype("<i2").tobytes() for k in range(3)}
    rows = [(k, i // size, bytearray(d[i : i + size]), i + size >= len(d)) for k, d in data.items() for i in range(0, len(d), size)]
    rows += r.sample(rows, len(rows) // 4)  # replays
    r.shuffle(rows)
    source, third = tmp_path / "in", -(-len(rows) // 3)
    for b in range(3):
        spark.createDataFrame(rows[b * third : (b + 1) * third], SCHEMA).coalesce(1).write.parquet(str(source / f"b{b}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    name = f"coded{size}"
    query = processors.run(stream, "encode").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {}
    for row in spark.table(name).orderBy("key", "seq").collect():
        assert row.error == 0
        got[row.key] = got.get(row.key, b"") + bytes(row.data)
    for k, d in data.items():
        encoder = container.Encoder(1, "deployable")
        assert got[k] == encoder.push(d) + encoder.finish()
        decoder = container.Decoder()
        assert decoder.push(got[k]) == d


def test_machine_waits_for_missing_slices():
    machine = processors.Machine("encode", 0, "host")
    assert list(machine.take(1, b"b", True)) == []
    ((n, made, done, error),) = [x for x in machine.take(0, b"a", False) if x[2]]
    assert done and error == 0 and list(machine.take(2, b"c", False)) == []
    broken = processors.Machine("decode", 0, "host")
    assert [x[2:] for x in broken.take(0, b"x" * 40, True)] == [(True, -2)]


@pytest.mark.parametrize("profile", ["deployable", "host"])
def test_state_rows_restore_machines(profile):
    """A machine put away and taken back after every slice makes the same bytes."""
    r = random.Random(4)
    data = np.cumsum([r.randint(-400, 400) if i % 700 > 300 else 0 for i in range(2000)]).astype("<i2").tobytes()

    def through(kind, data, cut):
        out, row = b"", None
        pieces = [data[i : i + cut] for i in range(0, len(data), cut)]
        for i, piece in enumerate(pieces):
            machine = processors.Machine(kind, 1, profile)
            if row is not None:
                machine.restore(row)
            for _, made, _, error in machine.take(i, piece, i == len(pieces) - 1):
                assert error == 0
                out += made
            row = machine.row()
            assert len(row) == len(processors.STATE.split(", "))
        return out

    coded = through("encode", data, 133)
    encoder = container.Encoder(1, profile)
    assert coded == encoder.push(data) + encoder.finish()
    assert through("decode", coded, 71) == data
