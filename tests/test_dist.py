import math

import numpy as np
import pytest

from cohortry.functions import dist, inference
from cohortry.functions.inference import Arm, two_sample


def test_quantiles():
    assert abs(dist.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-9
    assert abs(dist.chi2_ppf(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(dist.f_ppf(0.95, 1, 10) - 4.964602743730711) < 1e-8
    assert abs(dist.normal_ppf(0.975) - 1.959963984540054) < 1e-12
    assert abs(dist.t_cdf(dist.t_ppf(0.3, 4), 4) - 0.3) < 1e-10
    assert dist.f_tail(0, 2, 3) == 1 and abs(dist.chi2_tail(5.991464547107979, 2) - 0.05) < 1e-12


def test_welch_guards():
    with pytest.raises(ValueError):
        two_sample(Arm(1, 1, 1), Arm(1, 1, 10))
    few = two_sample(Arm(2, 1, 5), Arm(1, 1, 10))
    assert few.delta == 1 and math.isnan(few.p_value)
    assert two_sample(Arm(2, 0, 10), Arm(2, 0, 10)).p_value == 1 and two_sample(Arm(3, 0, 10), Arm(2, 0, 10)).p_value == 0
    assert math.isnan(two_sample(Arm(2, 1, 10), Arm(0, 1, 10)).percent)
    one = two_sample(Arm(2, float("nan"), 10), Arm(1, 0.5, 10))
    assert one.dof == 9 and abs(one.ci[1] - (1 + dist.t_ppf(0.975, 9) * math.sqrt(1.5))) < 1e-12
    other = two_sample(Arm(2, 0.5, 8), Arm(1, float("nan"), 10), law="z")
    assert other.dof == 7 and abs(other.ci[0] - (1 - 1.959963984540054 * math.sqrt(1.5))) < 1e-12
    # a negative control turns the sign of percentages
    assert two_sample(Arm(-1, 0.1, 10), Arm(-2, 0.1, 10)).percent == -50
    e = two_sample(Arm(1.5, 0.04, 50, 100), Arm(1.0, 0.05, 60, 110))
    assert e.dof == math.floor(0.09**2 / (0.04**2 / 49 + 0.05**2 / 59)) and e.delta_sum == 52.5 and e.sample_counts == (60, 50) and e.percent == 50
    with pytest.raises(ValueError):
        two_sample(Arm(1.5, 0.04, 50, 100), Arm(1.0, 0.05, 60, 200))
    assert abs(e.ci_sum[1] - (52.5 + dist.t_ppf(0.975, e.dof) * 105 * 0.3)) < 1e-9
    own = two_sample(Arm(1.5, 0.04, 50, 100), Arm(1.0, 0.05, 60, 200), same_population=False)
    assert own.delta_sum == -50 and abs(own.ci_sum[0] - (-50 - dist.t_ppf(0.975, own.dof) * math.sqrt(100**2 * 0.04 + 200**2 * 0.05))) < 1e-9
    z = two_sample(Arm(1.5, 0.04, 50), Arm(1.0, 0.05, 60), law="z")
    assert abs(z.ci[0] - (0.5 - 1.959963984540054 * 0.3)) < 1e-12


def test_contingency():
    x, p, dof, v = inference.chi2_independence(np.array([[10, 20], [30, 40]]))
    assert abs(x - 0.7936507936507936) < 1e-12 and dof == 1 and abs(v - math.sqrt(x / 100)) < 1e-12 and abs(p - 0.3729984836134872) < 1e-9
    assert inference.chi2_independence(np.ones((2, 3, 2)))[2] == 12 - 7 + 2
    g = inference.compare_distributions(np.array([[10, 20, 30]]), [1, 1, 1])
    assert g["dof"] == 2 and abs(g["statistic"] - 2 * (10 * math.log(0.5) + 30 * math.log(1.5))) < 1e-12
    assert inference.compare_distributions(np.array([[10, 20], [30, 40]]), method="pearson")["dof"] == 1


def test_interaction():
    n = np.full((2, 2), 50)
    flat = inference.interaction_f(np.array([[1.0, 2], [3, 4]]), np.ones((2, 2)), n)
    assert flat[0] < 1e-20 and flat[2:] == (1, 196)
    f, p, _, _ = inference.interaction_f(np.array([[1.0, 2], [3, 5]]), np.ones((2, 2)), n)
    assert abs(f - 50 * 4 * 0.0625) < 1e-9 and p < 0.01
    assert inference.interaction_f(np.array([[1.0, 2], [3, 0]]), np.ones((2, 2)), np.array([[5, 5], [5, 0]]))[2] == 0
