"""A profile and an embedder for tests: numbers from a seeded generator, no model."""

import random


def profile(**changes):
    plain = {
        "provider": "offline-tests",
        "model_id": "seeded",
        "model_revision": "7",
        "dimensions": 8,
        "input_role": "passage",
        "instruction": "none",
        "preprocessing": {"implementation": "none", "version": 1, "config": {"tokenizer": "none"}},
    }
    return plain | changes


class Embedder:
    offline = simulated = True
    adapter_identity = {"implementation": "seeded", "version": 1}

    def __call__(self, texts, profile):
        return [[random.Random(f"{profile['input_role']} {k} {text}").uniform(-1, 1) for k in range(profile["dimensions"])] for text in texts]
