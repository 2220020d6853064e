"""Compress or decompress one file: python -m serixa.cli compress --frontend i16 --input a --output b."""

from __future__ import annotations

import argparse
import sys

from .functions.bits import ALIASES
from .operators.codecs import container
from .operators.codecs.bitfields import CodecError


def main(arguments: list[str] | None = None) -> int:
    """0 on success, 1 on a failure, 2 on wrong usage."""
    parser = argparse.ArgumentParser(prog="serixa")
    parser.add_argument("command", choices=["compress", "c", "decompress", "d"])
    parser.add_argument("-f", "--frontend", default="i16", choices=sorted(ALIASES))
    parser.add_argument("-i", "--input", required=True)
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--profile", default="host", choices=container.PROFILES)
    try:
        asked = parser.parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        with open(asked.input, "rb") as file:
            data = file.read()
        if asked.command.startswith("c"):
            out = container.compress(data, ALIASES[asked.frontend], asked.profile)
        elif data[:4] == container.MAGIC and container.parse_header(data).live:
            decoder = container.Decoder()
            out = decoder.push(data)
            decoder.finish()
        else:
            out = container.decompress(data)
        with open(asked.output, "wb") as file:
            file.write(out)
    except (OSError, CodecError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    percent = len(out) * 100 // len(data) if data else 0
    print(f"{len(data)} -> {len(out)} bytes ({percent}%)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
