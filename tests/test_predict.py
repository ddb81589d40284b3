import numpy as np
import pytest

from pixelloom.codecs.predict import add_residual, hevc_block, vp8_block, vp8_subblock

MODES = ["DC", "TM", "VE", "HE", "LD", "RD", "VR", "VL", "HD", "HU"]


@pytest.mark.parametrize("mode", MODES)
def test_flat_edges_give_flat_blocks(mode):
    assert (vp8_subblock(mode, np.full(8, 77), np.full(4, 77), 77) == 77).all()


def test_subblock_modes_are_mirrors():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 256, 8), r.integers(0, 256, 4)
    swapped = np.r_[b, a[4:]]
    assert (vp8_subblock("VR", a, b, 50) == vp8_subblock("HD", swapped, a[:4], 50).T).all()
    assert (vp8_subblock("RD", a, b, 50) == vp8_subblock("RD", swapped, a[:4], 50).T).all()
    assert (vp8_subblock("TM", a, b, 50) == vp8_block("TM", a, b, 50, 4)).all()
    ramp = np.arange(8) * 10
    assert vp8_subblock("VE", ramp, np.zeros(4), 0)[0].tolist() == [3, 10, 20, 30]
    assert vp8_subblock("LD", ramp, np.zeros(4), 0)[0].tolist() == [10, 20, 30, 40]
    assert vp8_subblock("HU", ramp, np.array([0, 10, 20, 30]), 0).tolist() == [[5, 10, 15, 20], [15, 20, 25, 28], [25, 28, 30, 30], [30] * 4]


def test_whole_blocks_and_missing_edges():
    a, b = np.arange(16), np.arange(16) * 2
    assert vp8_block("DC", None, None)[0, 0] == 128
    assert vp8_block("DC", a, None)[3, 3] == 8
    assert (vp8_block("V", None, b) == 127).all() and (vp8_block("H", a, None) == 129).all()
    assert (vp8_block("V", a, b)[7] == a).all() and (vp8_block("H", a, b)[:, 7] == b).all()


@pytest.mark.parametrize("size", [4, 8, 16, 32])
def test_hevc_modes(size):
    r = np.random.default_rng(size)
    a, b = r.integers(0, 256, 2 * size), r.integers(0, 256, 2 * size)
    for mode in range(2, 35):
        assert (hevc_block(mode, a, b, 99, size) == hevc_block(36 - mode, b, a, 99, size).T).all()
        assert (hevc_block(mode, np.full(2 * size, 9), np.full(2 * size, 9), 9, size) == 9).all()
    assert (hevc_block(26, a, b, 99, size) == a[:size]).all() and (hevc_block(10, a, b, 99, size).T == b[:size]).all()
    assert (hevc_block(0, np.full(2 * size, 5), np.full(2 * size, 5), 5, size) == 5).all()
    assert hevc_block(1, a, b, 0, size)[1, 1] == (a[:size].sum() + b[:size].sum() + size) // (2 * size)


def test_residual_clamps():
    assert add_residual(np.array([250, 3], np.uint8), np.array([10, -9])).tolist() == [255, 0]
