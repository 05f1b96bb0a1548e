"""All named queries; importing the modules registers them."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import cleaning, features, profile, detect, evaluate, consumers, perturb, ledger, streaming, models  # noqa: F401
