"""Run configurations: profiles over a base, path variables, checks of policies and budgets, and a run's identity."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Mapping

#: Keys that say how a run executes, not what it computes.
EXECUTION_KEYS = ("partitions", "prefetch", "log_every", "output")


def merged(base: Mapping, overlay: Mapping) -> dict:
    """overlay over base: mappings merge key by key, anything else replaces."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str, profile: str | None = None) -> dict:
    """A JSON (or YAML, where a reader is installed) file; its `profiles` entry of that name is laid over the rest."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            config = yaml.safe_load(f)
        else:
            config = json.load(f)
    profiles = config.pop("profiles", {})
    if profile is None:
        return config
    if profile not in profiles:
        raise ValueError(f"unknown profile {profile}")
    return merged(config, profiles[profile])


def expanded(path: str) -> str:
    """path with environment variables put in; one that isn't set is an error."""
    out = os.path.expandvars(path)
    if "${" in out:
        raise ValueError(f"unresolved variable in {path}")
    return out


def check_policy(policy: Mapping) -> None:
    """Caps are positive whole numbers, weights finite and positive, budgets add up to their total."""
    for k, v in policy.get("caps", {}).items():
        if type(v) is not int or v < 1:
            raise ValueError(f"cap {k} must be a positive whole number")
    for k, v in policy.get("weights", {}).items():
        if type(v) not in (int, float) or not math.isfinite(v) or v <= 0:
            raise ValueError(f"weight {k} must be finite and positive")
    budgets = policy.get("budgets")
    if budgets is not None and sum(budgets.values()) != policy["total"]:
        raise ValueError("budgets don't add up to the total")


def identity(config: Mapping) -> str:
    """SHA-256 of what a run computes; runs of equal identity may continue one another."""
    kept = {k: v for k, v in config.items() if k not in EXECUTION_KEYS}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


#: Of a training run, by section: keys that have to be positive whole numbers, and those with a default.
POSITIVE = {"training": ("batch_size", "gradient_accumulation_steps", "epochs", "max_prompt_tokens", "max_target_tokens", "log_interval", "save_every_updates", "eval_every_updates")}
POSITIVE_OR_ABSENT = {"runtime": ("max_micro_batch_size", "eval_batch_size"), "training": ("max_updates",)}
WHOLE_OR_ABSENT = {"runtime": ("micro_batch_token_budget", "eval_parity_check_questions")}
FLAGS = {"runtime": ("auto_micro_batch", "adaptive_micro_batch", "length_balanced_batches")}
RATES = {"training": ("lr", "gate_lr", "grad_clip_norm")}
PRECISIONS = ("bfloat16", "float32")


def run_problems(config: Mapping) -> list[str]:
    """What is wrong with a training run's configuration, as section.key: rule; empty if nothing is."""
    absent = object()
    whole = lambda v, least: type(v) is int and v >= least
    number = lambda v: type(v) in (int, float) and math.isfinite(v)
    rules = [
        (POSITIVE, lambda v: whole(v, 1), "needs a positive whole number"),
        (POSITIVE_OR_ABSENT, lambda v: v is absent or v is None or whole(v, 1), "needs a positive whole number, if given"),
        (WHOLE_OR_ABSENT, lambda v: v is absent or whole(v, 0), "needs a whole number of zero or more, if given"),
        (FLAGS, lambda v: v is absent or type(v) is bool, "needs true or false, if given"),
        (RATES, lambda v: number(v) and v > 0, "needs a finite positive number"),
    ]
    at = lambda section, key: config.get(section, {}).get(key, absent)
    found = [f"{section}.{key}: {text}" for keys, fine, text in rules for section, names in keys.items() for key in names if not fine(at(section, key))]
    generated, target = at("evaluation", "max_new_tokens"), at("training", "max_target_tokens")
    if not whole(generated, 1) or (whole(target, 1) and generated < target):
        found.append("evaluation.max_new_tokens: has to cover the longest training answer")
    weight = at("training", "value_reconstruction_weight")
    if weight is not absent and not (number(weight) and weight >= 0):
        found.append("training.value_reconstruction_weight: needs a number of zero or more, if given")
    layers = at("cross_attention", "layers_1based")
    if not isinstance(layers, list) or not layers or len(set(layers)) != len(layers) or not all(whole(x, 1) for x in layers):
        found.append("cross_attention.layers_1based: needs distinct positive layers")
    heads, size = at("cross_attention", "heads"), at("cross_attention", "bridge_dim")
    if not (whole(heads, 1) and whole(size, 1) and size % heads == 0):
        found.append("cross_attention.bridge_dim: has to be a multiple of heads")
    if at("model", "torch_dtype") not in PRECISIONS:
        found.append(f"model.torch_dtype: needs one of {', '.join(PRECISIONS)}")
    block = config.get("memory", {}).get("block_shape", [1, 1])
    if len(block) != 2 or not all(whole(x, 1) for x in block):
        found.append("memory.block_shape: needs two positive whole numbers")
    return found
