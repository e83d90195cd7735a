"""Student-t tail probabilities against known values and the normal limit."""

import math

import pytest

from riskweave.functions.stats import gamma_ratio, two_sided_p


@pytest.mark.parametrize(
    "t, dof, p",
    [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 0.18350341907), (2.228138852, 10, 0.05), (12.7062047364, 1, 0.05), (1.9599639845, 1e9, 0.05),
     (636.619249, 1, 0.001), (3.290526731, 1e12, 0.001)],
)
def test_known_tails(t, dof, p):
    assert two_sided_p(t, dof) == pytest.approx(p, rel=1e-7)
    assert two_sided_p(-t, dof) == two_sided_p(t, dof)


@pytest.mark.parametrize("t", [0.3, 1.0, 2.0, 4.0])
def test_one_formula_from_few_to_very_many_degrees(t):
    assert two_sided_p(t, 1e13) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)
    tails = [two_sided_p(t, 10.0**k) for k in range(1, 13)]
    assert tails == sorted(tails, reverse=True)
    # two degrees have a closed form
    assert two_sided_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


@pytest.mark.parametrize("a", [0.5, 1.0, 7.5, 31.9, 32.0, 150.0])
def test_gamma_ratio(a):
    assert gamma_ratio(a) == pytest.approx(math.exp(math.lgamma(a + 0.5) - math.lgamma(a)), rel=1e-12)
