"""Planner and solver options, patched from JSON: all of a patch is taken, or none of it."""

from __future__ import annotations

import copy
import json

#: The options with their defaults, the inlining modes by ordinal, and names of old options that are ignored.
PLANNER = {
    "nonoptimal": True, "tagPruning": True, "recipePruning": True, "directPruning": True, "substitutionPruning": True, "seedPruning": True, "tagTidy": True, "flash": False, "flashProbe": True, "tagInlining": "queryTime",
    "maxTagMembers": 1024, "maxTagPairs": 4_000_000, "maxWitnessPairs": 4_000_000, "maxPrunePairs": 4_000_000, "maxTagCoverWork": 64_000_000, "maxSubstitutionWork": 64_000_000, "maxSubstitutionCostWork": 256_000_000,
    "maxSiblingRecipes": 2048, "maxWitnessProducers": 2048, "maxSubstitutionDepth": 4, "maxCostDepth": 16, "maxSubstitutionGuardItems": 256, "maxSubstitutionGuardTotal": 1_000_000, "maxNeed": 2**40, "maxPropIterations": 4096,
    "pack": {"enabled": True, "maxPackRecipes": 128, "maxPackValue": 1024, "maxBranchDepth": 8, "maxBranchNodes": 4096, "maxZeroStockItems": 32, "maxSeconds": 60.0},
    "satellite": {"enabled": True, "enabledOnFlash": False, "maxComponentNodes": 512, "maxIslandNodes": 4096, "maxSeconds": 0.05},
    "variantClass": {"enabled": True, "maxClassNodes": 4096, "maxCandidates": 4096, "maxSeconds": 0.05}, "tagExclusive": {"enabled": True, "maxSeconds": 0.05}, "variantFold": {"enabled": True, "maxFoldItems": 4096, "maxSeconds": 1.0},
}
SOLVER = {"relativeGap": 0.01, "absoluteGap": 0, "maxTimeSeconds": 2.0, "numWorkers": 16, "randomSeed": 1, "objectiveCap": 0, "objectiveUpperBound": 0, "reducedCostGap": 0.0, "maxCycleRetries": 3, "maxStartupGroups": 1024, "maxStartupGroupMembers": 32}
MODES = ["off", "prePrune", "queryTime", "both"]
RETIRED = frozenset({"deadNodePruning", "maxCostMemo", "outputPruningProfile", "flash"})


class BadOption(ValueError):
    pass


def _taken(name: str, old: object, new: object) -> object:
    if name == "tagInlining":
        if isinstance(new, str) and new in MODES:
            return new
        if isinstance(new, int) and not isinstance(new, bool) and 0 <= new < len(MODES):
            return MODES[new]
        raise BadOption(f"{name} is not a known mode")
    if isinstance(old, dict):
        if not isinstance(new, dict):
            raise BadOption(f"{name} must be an object")
        return patched(old, new, frozenset())
    if isinstance(old, bool) or isinstance(new, bool):
        if not (isinstance(old, bool) and isinstance(new, bool)):
            raise BadOption(f"{name} has the wrong type")
        return new
    if isinstance(old, float):
        if not isinstance(new, int | float):
            raise BadOption(f"{name} must be a number")
        return float(new)
    if not isinstance(new, int):
        raise BadOption(f"{name} must be an integer")
    if not 0 <= new < 2**63:
        raise BadOption(f"{name} is out of range")
    return new


def patched(options: dict, patch: dict | str, retired: frozenset[str] = RETIRED) -> dict:
    """A copy of `options` with the patch applied; `BadOption` names the first thing wrong with it."""
    if isinstance(patch, str):
        try:
            patch = json.loads(patch)
        except json.JSONDecodeError as e:
            raise BadOption(f"not JSON: {e}") from e
    if not isinstance(patch, dict):
        raise BadOption("a patch must be an object")
    out = copy.deepcopy(options)
    for name, new in patch.items():
        if name in options:
            out[name] = _taken(name, options[name], new)
        elif name not in retired:
            raise BadOption(f"unknown option: {name}")
    return out


def dumped(options: dict) -> str:
    return json.dumps(options)
