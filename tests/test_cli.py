import random

import numpy as np

from serixa.cli import main
from serixa.operators.codecs import container


def test_round_trip(tmp_path):
    r = random.Random(1)
    data = np.cumsum([r.randint(-3, 3) for _ in range(200)]).astype("<i2").tobytes()
    (tmp_path / "a").write_bytes(data)
    for profile in container.PROFILES:
        assert main(["compress", "-f", "i16", "-i", f"{tmp_path}/a", "-o", f"{tmp_path}/b", "--profile", profile]) == 0
        assert main(["d", "-i", f"{tmp_path}/b", "-o", f"{tmp_path}/c"]) == 0
        assert (tmp_path / "c").read_bytes() == data
    encoder = container.Encoder(1)
    (tmp_path / "live").write_bytes(encoder.push(data) + encoder.finish())
    assert main(["decompress", "-i", f"{tmp_path}/live", "-o", f"{tmp_path}/c"]) == 0 and (tmp_path / "c").read_bytes() == data


def test_failures(tmp_path):
    (tmp_path / "x").write_bytes(b"no container at all, nothing to see")
    assert main(["d", "-i", f"{tmp_path}/x", "-o", f"{tmp_path}/y"]) == 1
    assert main(["d", "-i", f"{tmp_path}/none", "-o", f"{tmp_path}/y"]) == 1
    assert main(["c", "-f", "fire", "-i", f"{tmp_path}/x", "-o", f"{tmp_path}/y"]) == 2
    assert main([]) == 2
