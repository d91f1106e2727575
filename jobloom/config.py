"""Operating limits; ``as_of`` is given, never read from the clock."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from datetime import datetime


@dataclass(frozen=True)
class Settings:
    """Constants of one run. Times are UTC."""

    as_of: datetime = datetime(1999, 1, 1)
    expiry_days: int = 30
    recheck_days: int = 3
    deletion_days: int = 60
    check_limit: int = 50
    score_limit: int = 10
    analyse_limit: int = 200
    keyword_batch: int = 10
    write_chunk: int = 500
    generate_limit: int = 2

    @classmethod
    def from_environment(cls, as_of: datetime, prefix: str = "JOBLOOM_") -> Settings:
        """Whole-number settings may be overridden by environment variables such as JOBLOOM_CHECK_LIMIT."""
        given = {f.name: int(os.environ[prefix + f.name.upper()]) for f in fields(cls) if f.name != "as_of" and prefix + f.name.upper() in os.environ}
        return cls(as_of=as_of, **given)
