"""Work of the admission loop."""

import cProfile
import pstats

import numpy as np

from tandem.operators.roles import Admission


def test_profiles_without_partners_that_have_room_cost_few_calls():
    # rule 2: profiles 0 to 4,999 embody a word that only the claims of the last three share
    n = 5000
    who = np.arange(n + 3)
    side = np.where(who < n, 1, 0)
    spec = np.where(side == 0, 1.0, np.nan)
    loop = Admission(2, who, np.full(n + 3, 2), np.zeros(n + 3, np.int64), np.zeros(n + 3, np.int64), side, spec)
    watch = cProfile.Profile()
    a, b = watch.runcall(loop.run, 2)
    assert list(zip(a.tolist(), b.tolist())) == [(0, n), (0, n + 1), (1, n), (1, n + 1), (2, n + 2), (3, n + 2)]
    assert pstats.Stats(watch).total_calls < 2 * n
