"""Push encoding and decoding as keyed streaming state.

Rows carry (key, seq, data, last): slices of a key's bytes in order of seq, from
0 on; `last` ends it.  Slices that come early wait in a map of the state store, however
many; a seq that was taken before is dropped, so a replayed batch changes nothing.
The rest of a key's state is a row of plain fields (STATE), some kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.codecs.bitfields import CodecError
from ..operators.codecs.container import CHUNK, Decoder, Encoder, Header

OUTPUT = "key long, seq long, data binary, done boolean, error int"

#: The order of slices, the predictor, the model's counts (16-bit), bytes that wait, sums of what was taken and made, and a decoder's header.
STATE = (
    "next long, out long, ended boolean, last long, older long, gain long, ts long, px long, counts binary, held binary, unlearned binary, "
    "crc long, taken long, made long, begun boolean, done boolean, flags long, orig_len long, coded_len long, crc32 long"
)


class Machine:
    """One key's encoder or decoder with the order of its slices."""

    def __init__(self, kind: str, frontend: int, profile: str, early: MutableMapping | None = None):
        self.codec = Encoder(frontend, profile) if kind == "encode" else Decoder()
        self.next, self.out, self.ended, self.early = 0, 0, False, {} if early is None else early

    def row(self) -> tuple:
        """The fields of STATE."""
        codec, predictor = self.codec, self.codec.state
        counts = np.array(codec.model.tables, "<u2").tobytes()
        common = (self.next, self.out, self.ended, predictor.last, predictor.older, predictor.gain, predictor.ts, predictor.px, counts)
        if isinstance(codec, Encoder):
            return (*common, codec.waiting, b"", codec.crc, codec.orig, codec.coded, codec.begun, codec.done, None, None, None, None)
        head = codec.header
        told = (head.flags, head.orig_len, head.coded_len, head.crc32) if head else (None,) * 4
        # what the model hasn't seen are whole records' residuals, of which the lengths don't matter
        return (*common, codec.buffer, b"".join(codec.unlearned), codec.crc, codec.decoded, codec.seen, head is not None, codec.done, *told)

    def restore(self, row: tuple) -> None:
        self.next, self.out, self.ended = int(row[0]), int(row[1]), bool(row[2])
        codec, predictor = self.codec, self.codec.state
        predictor.last, predictor.older, predictor.gain, predictor.ts, predictor.px = map(int, row[3:8])
        codec.model.tables = np.frombuffer(bytes(row[8]), "<u2").reshape(-1, 16).astype(int).tolist()
        held, unlearned = bytes(row[9]), bytes(row[10])
        codec.crc, codec.done = int(row[11]), bool(row[15])
        if isinstance(codec, Encoder):
            codec.waiting, codec.orig, codec.coded, codec.begun = held, int(row[12]), int(row[13]), bool(row[14])
        else:
            codec.buffer, codec.decoded, codec.seen = held, int(row[12]), int(row[13])
            codec.unlearned = [unlearned[i : i + CHUNK] for i in range(0, len(unlearned), CHUNK)]
            codec.header = Header(*map(int, row[16:20])) if row[14] else None

    def take(self, seq: int, data: bytes, last: bool) -> Iterator[tuple[int, bytes, bool, int]]:
        """(number, bytes, done, error) of what becomes due."""
        if self.ended or seq < self.next or seq != self.next and seq in self.early:
            return
        due = (bytes(data or b""), bool(last))
        if seq != self.next:
            self.early[seq] = due
            return
        while due is not None and not self.ended:
            piece, final = due
            self.next += 1
            due = self.early.pop(self.next) if self.next in self.early else None
            error, made = 0, b""
            try:
                made = self.codec.push(piece)
                if final:
                    made += self.codec.finish() or b""
            except CodecError as problem:
                error, final = problem.code, True
            self.ended = final
            if made or final:
                yield self.out, made, final, error
                self.out += 1


class Waiting:
    """Early slices in the state store, used as a mapping of seq to (data, last)."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, seq: int) -> bool:
        return self.state.exists() and self.state.containsKey((seq,))

    def __setitem__(self, seq: int, slice_: tuple[bytes, bool]) -> None:
        self.state.updateValue((seq,), slice_)

    def pop(self, seq: int) -> tuple[bytes, bool]:
        data, last = self.state.getValue((seq,))
        self.state.removeKey((seq,))
        return bytes(data), bool(last)


class CodecProcessor(StatefulProcessor):
    def __init__(self, kind: str, frontend: int = 1, profile: str = "deployable"):
        self.kind, self.frontend, self.profile = kind, frontend, profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", STATE)
        self.early = handle.getMapState("early", "seq long", "data binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = Machine(self.kind, self.frontend, self.profile, Waiting(self.early))
        if self.state.exists():
            machine.restore(tuple(self.state.get()))
        out = []
        for frame in rows:
            frame = frame.sort_values("seq")
            for seq, data, last in zip(frame["seq"], frame["data"], frame["last"]):
                out += machine.take(int(seq), data, bool(last))
        self.state.update(machine.row())
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["key", "seq", "data", "done", "error"])

    def close(self) -> None:
        pass


def run(slices: DataFrame, kind: str, frontend: int = 1, profile: str = "deployable") -> DataFrame:
    """A streaming frame of output slices; kind is "encode" or "decode"."""
    spark = slices.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.streams.active  # noqa: B018  starts the state stores' coordinator, which a batch run needs too
    return slices.groupBy("key").transformWithStateInPandas(CodecProcessor(kind, frontend, profile), OUTPUT, "append", "none")
