"""Generators of synthetic tables."""

from tabloom.operators.synthesis.copula import gaussian_copula
from tabloom.operators.synthesis.independent import independent
from tabloom.operators.synthesis.repair import repair_domains
from tabloom.operators.synthesis.sequential import sequential

__all__ = ["gaussian_copula", "independent", "repair_domains", "sequential"]
