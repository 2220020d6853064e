"""Codecs of single buffers: round trips, known sizes, corruption, slices."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from serixa.operators.codecs import CODECS, SAMPLES_ONLY, bitpack, container, genome, nibbles, peers, plateau, residual
from serixa.operators.codecs.bitfields import CodecError
from serixa.sources.generators import CORPORA, ramp

LENGTHS = [0, 1, 2, 7, 8, 9, 62, 63, 64, 65, 254, 255, 256, 257, 258, 511, 512, 513, 1030]


def buffers():
    r = random.Random(2)
    for n in LENGTHS:
        yield bytes(n)
        yield bytes(r.randrange(256) for _ in range(n))
        yield bytes(r.choice((0, 0, 0, 1, 17)) for _ in range(n))
        yield np.cumsum([r.randint(-3, 3) for _ in range(n // 2)]).astype("<i2").tobytes() + b"x" * (n % 2)
    yield np.array([-32768, 32767] * 100, "<i2").tobytes()
    for blocks in (255, 256, 257, 600):
        yield np.array([5] * 8 * blocks + [9, 1, 4], "<i2").tobytes()


@pytest.mark.parametrize("codec", sorted(CODECS))
def test_round_trip(codec):
    encode, decode = CODECS[codec]
    for data in buffers():
        if codec in SAMPLES_ONLY and len(data) % 2:
            continue
        payload = encode(data)
        assert decode(payload) == data
        if codec.startswith("core"):
            assert len(payload) <= container.bound(len(data))


@pytest.mark.parametrize("codec", sorted(CODECS))
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-40, 40) | st.integers(-32768, 32767), max_size=300))
def test_round_trip_any(codec, steps):
    data = residual.to_bytes(np.cumsum(np.array(steps, np.int64)))
    assert CODECS[codec][1](CODECS[codec][0](data)) == data


@pytest.mark.parametrize("codec", sorted(CODECS))
def test_broken_payloads_never_hang_or_pass_silently(codec):
    encode, decode = CODECS[codec]
    r = random.Random(4)
    data = np.cumsum([r.randint(-9, 9) for _ in range(300)]).astype("<i2").tobytes()
    payload = encode(data)
    for cut in range(0, len(payload), 7):
        with pytest.raises(CodecError):
            if decode(payload[:cut]) != data:
                raise CodecError(-2, "short")
    for _ in range(60):
        broken = bytearray(payload)
        broken[r.randrange(len(broken))] ^= 1 << r.randrange(8)
        try:
            decode(bytes(broken))
        except CodecError:
            pass


def test_checksum():
    payload = bytearray(container.compress(bytes(range(1, 9)), residual.NONE))
    payload[28] ^= 255
    with pytest.raises(CodecError) as problem:
        container.decompress(bytes(payload))
    assert problem.value.code == -3


@pytest.mark.parametrize("size", [1, 7, 17, 256, 1000])
@pytest.mark.parametrize("frontend", range(5))
@pytest.mark.parametrize("profile", container.PROFILES)
def test_push_in_slices(size, frontend, profile):
    for data in (b"", np.array([1000 + i for i in range(300)], "<i2").tobytes(), ramp(), CORPORA["ticks_16k"]()[:2003]):
        encoder, decoder = container.Encoder(frontend, profile), container.Decoder()
        coded = b"".join(encoder.push(data[i : i + size]) for i in range(0, len(data), size)) + encoder.finish()
        out = b"".join(decoder.push(coded[i : i + size]) for i in range(0, len(coded), size))
        decoder.finish()
        assert out == data
        assert container.parse_header(coded).live
        short = container.Decoder()
        short.push(coded[:-1])
        with pytest.raises(CodecError):
            short.finish()


def test_range_records_avoid_the_kinds_of_other_records():
    r = random.Random(8)
    for seed in range(12):
        data = bytes(r.choices(range(256), weights=[3 if b < 200 else 1 for b in range(256)], k=256 * 20))
        payload = container.compress(data, residual.NONE)
        assert container.decompress(payload) == data, seed


def test_one_decoder_reads_legacy_forms():
    data = np.cumsum([3, 1, -2, 5] * 100).astype("<i2").tobytes()
    rest = residual.State().forward(residual.DELTA, data)
    crc = zlib.crc32(data)
    packed = bitpack.encode(np.frombuffer(rest, "<u2"))
    whole = container.Header(2 | 16 | 32, len(data), len(packed) + 5, crc).pack() + b"\xfa" + struct.pack("<I", len(packed)) + packed
    stored = container.Header(1 | 2, len(data), len(data), crc).pack() + rest
    model, chunks, flags = nibbles.Model(), [], 0
    for i in range(0, len(rest), 256):
        coded = nibbles.encode(model, rest[i : i + 256])
        flags |= 1 << i // 256
        chunks.append(bytes((len(coded),)) + coded)
    body = bytes((flags,)) + b"".join(chunks)
    ranged = container.Header(2 | 16, len(data), len(body), crc).pack() + body
    for payload in (whole, stored, ranged):
        assert container.decompress(payload) == data
        with pytest.raises(CodecError):
            container.decompress(payload[:-3])


@pytest.mark.parametrize(
    ("corpus", "codec", "size"),
    [
        ("harness128", "core", 106), ("harness128", "drh", 15), ("harness128", "proglz", 111), ("harness128", "schulduhr", 36),
        ("timeseries_16k", "core", 9627), ("timeseries_16k", "drh", 12273), ("timeseries_16k", "proglz", 10771), ("timeseries_16k", "schulduhr", 41852),
        ("ticks_16k", "core_tick8", 4027), ("logline_16k", "core_bytes", 9707), ("random_16k", "core_bytes", 16544),
        ("joint_7axis_1khz_10s", "core_deployable", 45193), ("joint_7axis_1khz_10s", "sprintz_d", 44071),
    ],
)
def test_published_sizes(corpus, codec, size):
    assert len(CODECS[codec][0](CORPORA[corpus]())) == size


def test_fire_many_is_fire():
    r = random.Random(6)
    rows = [[r.randint(-32768, 32767) if r.random() < 0.1 else r.randint(-50, 50) for _ in range(n)] for n in (0, 1, 2, 40, 7, 300)]
    offsets = np.cumsum([0, *map(len, rows)])
    errors = residual.fire_many(offsets, np.array(sum(rows, [])), True)
    assert errors.tolist() == sum((residual.State().learn(row, True) for row in rows), [])
    assert residual.fire_many(offsets, errors, False).tolist() == sum(rows, [])


def test_plateau_overlap_and_limits():
    data = b"ab" * 500 + bytes(300)
    assert plateau.decode(plateau.encode(data)) == data
    for n in (15, 65537):
        with pytest.raises(CodecError):
            plateau.encode(bytes(n))


def test_sprintz_dimensions():
    x = np.random.default_rng(1).integers(-900, 900, 64 * 30)
    assert (peers.sprintz_decode(peers.sprintz_encode(x, 64)) == x).all()
    for dims in (0, 256, 7):
        with pytest.raises(CodecError):
            peers.sprintz_encode(x, dims)


def test_genome():
    for bases in (b"", b"A", b"CG", b"TTT", b"ACGT", b"ACGTA"):
        assert genome.dna2_decode(genome.dna2_encode(bases)) == bases
    good = b"@r1 x\nACGTN\n+\nIIIII\n".replace(b"N", b"A") + b"@r2\n\n+r2\n\n"
    assert genome.fastq4_decode(genome.fastq4_encode(good)) == good
    assert genome.fastq4_decode(genome.fastq4_encode(b"")) == b""
    for bad in (good[:-1], good.replace(b"\n", b"\r\n"), b"@r\nACGN\n+\nIIII\n", b"@r\nACG\n+\nII\n", b"r\nA\n+\nI\n", b"@r\nA\n+\n"):
        with pytest.raises(CodecError):
            genome.fastq4_encode(bad)
    for bad in (b"acgt", b"ACGN"):
        with pytest.raises(CodecError):
            genome.dna2_encode(bad)
    for cut in range(1, 20):
        with pytest.raises(CodecError):
            genome.fastq4_decode(genome.fastq4_encode(good)[:-cut])


def test_whole_deployable_streams_equal_pushed_ones():
    """Records made all at once are those of the push encoder, zeros, short ends and wide residuals included."""
    from serixa.operators.codecs import container
    from serixa.operators.codecs.residual import FIRE, I16

    r = random.Random(21)
    for _ in range(150):
        x, out = 0, []
        for _ in range(r.randint(1, 700)):
            x = r.choice([x, x, x, x + r.randint(-3, 3), r.randint(-32768, 32767) if r.random() < 0.2 else x])
            x = max(-32768, min(32767, x))
            out += [x] * r.choice([1, 1, 1, 9, 200])
        data = np.array(out, "<i2").tobytes()
        for frontend in (I16, FIRE):
            encoder = container.Encoder(frontend, "deployable", live=False)
            body = encoder.push(data[:1001]) + encoder.push(data[1001:]) + encoder.finish()
            head = container.Header(encoder.flags, len(data), len(body), zlib.crc32(data)).pack()
            whole = container.stream_block(data, frontend, "deployable")
            assert whole == head + body and container.decompress(whole) == data


def test_memory_sink_refuses_what_does_not_fit():
    from serixa.operators.codecs.bitfields import DST, CodecError
    from serixa.sources.sinks import MemorySink

    sink = MemorySink(5)
    assert sink.write(b"abc") == 3
    with pytest.raises(CodecError) as told:
        sink.write(b"def")
    assert told.value.code == DST and bytes(sink.data) == b"abc" and sink.write(b"de") == 2


def test_broken_byte_peers():
    from serixa.operators.codecs.bitfields import CodecError
    from serixa.operators.codecs.byte_peers import BYTE_PEERS

    for name, (encode, decode) in BYTE_PEERS.items():
        for data in (b"", b"\0" * 700, b"abc" * 300, bytes(range(256)) * 3):
            assert decode(encode(data)) == data
        if name != "windowed":  # that one reads any bits
            for broken in (b"\xff" * 20, encode(bytes(range(200)))[:9], b"\x01"):
                with pytest.raises(CodecError):
                    decode(broken)
