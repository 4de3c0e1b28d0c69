"""All registered queries of the library proper: name -> function, name -> SQL twin."""

from __future__ import annotations

from tallyfield.plans import features, learning, listed, market, more, remainders, reports, rules, streams, tables, upkeep, variants  # noqa: F401  (they register)
from tallyfield.plans.base import ORACLES, QUERIES  # noqa: F401
