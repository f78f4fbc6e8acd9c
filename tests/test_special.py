"""Tail probabilities against published values and numerical integration."""

import math

import pytest

from assay.functions.special import chi2_tail, k2_test, kolmogorov_tail, kurtosis_z, normal_two_sided, shapiro_wilk, skew_z


@pytest.mark.parametrize(("x", "dof", "p"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0.0, 3, 1.0)])
def test_chi_square_quantiles(x, dof, p):
    assert chi2_tail(x, dof) == pytest.approx(p, rel=1e-9)


def test_normal_and_kolmogorov():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert kolmogorov_tail(1.3581 / 1e3, 1e6) == pytest.approx(0.05, abs=1e-3)
    assert kolmogorov_tail(0.0, 10) == 1.0 and kolmogorov_tail(1.0, 100) == pytest.approx(0.0)


def test_shapiro_on_a_published_sample():
    # Shapiro and Wilk (1965): weights of eleven men
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    assert shapiro_wilk([1, 1, 1, 1]) == (1.0, 1.0)


def test_moment_tests_are_symmetric():
    assert skew_z(0.5, 100) == pytest.approx(-skew_z(-0.5, 100))
    assert kurtosis_z(1.0, 200) > 0 > kurtosis_z(-1.0, 200)
    k2, p = k2_test(0.0, 0.0, 500)
    assert p == pytest.approx(math.exp(-k2 / 2)) and p > 0.5
