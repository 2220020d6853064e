"""Byte-exact codecs of one buffer at a time, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import container, peers
from .byte_peers import BYTE_PEERS
from .residual import DELTA, FIRE, I16, NONE, TICK8, samples, to_bytes


def _series(encode: Callable, decode: Callable) -> tuple[Callable, Callable]:
    return (lambda data: encode(samples(data)), lambda payload: to_bytes(decode(payload)))


def _core(frontend: int, profile: str) -> tuple[Callable, Callable]:
    return (lambda data: container.compress(data, frontend, profile), container.decompress)


#: (encode, decode) of bytes by codec name; the host profile's name stands alone.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "core": _core(I16, "host"),
    "core_deployable": _core(I16, "deployable"),
    "core_delta": _core(DELTA, "host"),
    "core_fire": _core(FIRE, "host"),
    "core_fire_deployable": _core(FIRE, "deployable"),
    "core_tick8": _core(TICK8, "host"),
    "core_tick8_deployable": _core(TICK8, "deployable"),
    "core_bytes": _core(NONE, "host"),
    "core_bytes_deployable": _core(NONE, "deployable"),
    "sprintz_d": _series(peers.sprintz_encode, peers.sprintz_decode),
    "drh": _series(peers.drh_encode, peers.drh_decode),
    "proglz": _series(peers.proglz_encode, peers.proglz_decode),
    "schulduhr": _series(peers.schulduhr_encode, peers.schulduhr_decode),
    **BYTE_PEERS,
}
#: Codecs of whole 16-bit samples only.
SAMPLES_ONLY = frozenset(("sprintz_d", "drh", "proglz", "schulduhr"))
