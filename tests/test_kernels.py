"""The helpers against analytic facts."""

import numpy as np
import pytest

from sigmill.functions import kernels as k

FS = 250.0
T = np.arange(2000) / FS
RNG = np.random.default_rng(1)


@pytest.mark.parametrize("kind,order,low,high", [("bandpass", 4, 0.2, 50), ("bandpass", 5, 1, 50), ("bandpass", 4, 8, 13), ("bandstop", 4, 59, 61)])
def test_cutoffs_are_half_power(kind, order, low, high):
    h = np.abs(k.frequency_response(*k.butterworth(kind, order, low, high, FS), np.array([low, high]), FS))
    assert np.allclose(h, np.sqrt(0.5), atol=1e-6)


def test_lowpass_order_and_edge():
    order, cut = k.lowpass_order(0.45, 30, 1, 60, FS)
    assert order == 2 and abs(cut - 0.631) < 1e-3
    h = np.abs(k.frequency_response(*k.butterworth("lowpass", order, 0, cut, FS), np.array([0.0, 0.45]), FS))
    assert np.allclose(h, [1, 10 ** (-1 / 20)], atol=1e-6)


def test_notch_removes_its_frequency_only():
    h = np.abs(k.frequency_response(*k.notch_section(50, 30, FS), np.array([50.0, 10, 0]), FS))
    assert h[0] < 1e-9 and np.allclose(h[1:], 1, atol=1e-3)


def test_zero_phase_keeps_alpha_and_kills_mains():
    t = np.arange(15000) / FS  # long enough for the 0.2 Hz edge to settle
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 60 * t)
    y = k.filter_rows(k.filter_rows(x[None], "bandpass", FS), "bandstop", FS, 59, 61)[0]
    mid = slice(7000, 8000)
    assert np.abs(y - np.sin(2 * np.pi * 10 * t))[mid].max() < 0.05


def test_constant_gives_zero_and_short_rows_nan():
    assert np.abs(k.filter_rows(np.ones((1, 1000)), "bandpass", FS)).max() < 1e-6
    assert k.filter_rows(np.ones((1, 27)), "bandpass", FS) is None
    assert not np.isnan(k.filter_rows(np.ones((1, 28)), "bandpass", FS)).any()
    assert k.filter_rows(np.ones((1, 500)), "bandstop", 100.0, 59, 61) is None


def test_matrix_form_is_the_filter():
    x = RNG.normal(size=(3, 500))
    s, g, pad = k.named_filter("bandpass", FS)
    assert np.allclose(k.filter_rows(x, "bandpass", FS), k.zero_phase(s, g, x, pad), atol=1e-9)


def test_reference_average_commutes_with_filter():
    x = RNG.normal(size=(8, 600))
    a = k.filter_rows(x - x.mean(0), "bandpass", FS)
    b = k.filter_rows(x, "bandpass", FS)
    assert np.allclose(a, b - b.mean(0), atol=1e-9)


def test_blocks_chain_to_the_whole_filter():
    s, g, _ = k.named_filter("bandpass", FS)
    x = RNG.normal(size=(1, 4000))
    whole, _ = k.run_sections(s, g, x, np.zeros((len(s), 2, 1)))
    y, end = k.block_responses(s, g, x.reshape(8, 500))
    starts = k.chain_blocks(s, end.reshape(-1, 8).T, np.zeros(2 * len(s)), 500)
    assert np.allclose(k.add_state(s, y, starts).ravel(), whole[0], atol=1e-8)


def test_trailing_weights_give_last_value():
    x = RNG.normal(size=(1, 125))
    y = k.filter_rows(k.filter_rows(x, "notch", FS, 50), "bandpass", FS, 1, 50, 5)
    assert abs(y[0, -1] - x[0] @ k.trailing_weights(125, FS)) < 1e-9


def test_welch_integrates_to_the_variance():
    x = RNG.normal(size=(1, 50000))
    f, p = k.welch(x, FS)
    assert abs(np.trapezoid(p[0], f) / x.var() - 1) < 0.02


def test_fft_power_of_a_sine():
    f, p = k.fft_power(np.sin(2 * np.pi * 10 * T[None, :250]), 256.0, 256)
    assert p.shape == (1, 256) and f[p[0, :128].argmax()] in (10, 11)


def test_envelope_is_the_amplitude():
    assert np.allclose(k.envelope(3 * np.cos(2 * np.pi * 10 * T[None])), 3, atol=1e-9)


@pytest.mark.parametrize("n", [1000, 1001, 257])
def test_wavelet_rebuilds(n):
    x = RNG.normal(size=(2, n))
    assert np.allclose(k.wavelet_reference(x, soften=()), x, atol=1e-9)


def test_wavelet_lengths():
    x, sizes = RNG.normal(size=(1, 1001)), []
    for _ in range(7):
        x, d = k.dwt(x)
        sizes.append(d.shape[1])
    assert sizes == [504, 255, 131, 69, 38, 22, 14]


def test_rls_sums_are_the_recursion():
    x, ref = RNG.normal(size=(1, 300)), RNG.normal(size=(1, 300))
    e, w = k.rls_cancel(x, ref)
    p, weight = 1e4, 1.0
    for i in range(300):
        assert abs(w[0, i] - weight) < 1e-8
        gain = p * ref[0, i] / (0.98 + p * ref[0, i] ** 2)
        weight += gain * (x[0, i] - weight * ref[0, i])
        p = (p - gain * p * ref[0, i]) / 0.98


def test_kalman_gain_settles():
    assert abs(k.kalman_gains(12)[-1] - 0.618034) < 1e-6
