"""Logging to the console and, if a file is named, to that file, which rotates."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

_FORMAT = "%(asctime)s | %(levelname)-8s | %(name)s:%(funcName)s:%(lineno)d - %(message)s"
logger = logging.getLogger("corpusmill")


def setup(level: str = "INFO", file: str = "", most_bytes: int = 10 << 20, kept: int = 30) -> logging.Logger:
    """Set the package's handlers anew; ``kept`` rotated files of ``most_bytes`` stay."""
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(RotatingFileHandler(file, maxBytes=most_bytes, backupCount=kept, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter(_FORMAT))
        logger.addHandler(h)
    logger.setLevel(level.upper())
    return logger
