"""Registered queries of the engine, each beside its SQL oracle."""

from .matching import ORACLES as _m_sql, QUERIES as _m
from .presenting import ORACLES as _p_sql, QUERIES as _p
from .profiling import ORACLES as _t_sql, QUERIES as _t
from .reporting import ORACLES as _r_sql, QUERIES as _r
from .selecting import ORACLES as _s_sql, QUERIES as _s
from .storing import ORACLES as _f_sql, QUERIES as _f

QUERIES = _s | _m | _p | _t | _f | _r
ORACLES = _s_sql | _m_sql | _p_sql | _t_sql | _f_sql | _r_sql
