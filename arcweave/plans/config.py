"""Settings of the pipeline and of the evaluation, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Strategy:
    """One loading strategy: ``kind`` is its key in ``schedule.STRATEGIES``."""

    kind: str
    name: str
    batch_size: int = 1000
    thread_count: int = 1
    max_retries: int = 0
    options: dict = field(default_factory=dict)


# Names and sizes of the strategies.
STRATEGIES = (
    Strategy("sequential", "Sequential insertion"),
    Strategy("naive_parallel", "Naive parallelization", thread_count=14),
    Strategy("mix_and_batch", "Mix and Batch", thread_count=14, options={"n": 10, "digits": 1}),
    Strategy("batched_parallel", "Batched parallel", thread_count=14),
    Strategy("batched_sequential", "Batched sequential"),
    Strategy("color_batch", "Color Batch Insert", thread_count=14),
)
_PREFIXES = {"sequential": "sequential", "naive_parallel": "naive_parallel", "mix_and_batch": "mix_and_batch", "apoc": "batched_parallel", "sapoc": "batched_sequential", "color_batch": "color_batch"}


@dataclass(frozen=True)
class Config:
    """``model``: recogniser and sentence splitter, by rules where it is not installed; ``image_model``: an ONNX file, ``image_labels``
    its classes; ``hub``: the source of scenario s1, the largest one if empty."""

    text_dir: str = "data/input/text/"
    images_dir: str = "data/input/images/"
    output: str = "data/output"
    model: str = "en_core_web_lg"
    image_model: str = ""
    image_labels: tuple[str, ...] = ()
    hub: str = ""
    evaluate: bool = True
    scenarios: tuple[str, ...] = ("s1", "s2", "s3")
    runs: int = 3
    results: str = "data/evaluation/"
    store: str = "data/graph"
    strategies: tuple[Strategy, ...] = STRATEGIES


def from_mapping(raw: dict) -> Config:
    """Settings from a nested mapping; what is missing keeps its default. A strategy's key may go on after its kind."""
    data, evaluation, images = raw.get("data", {}), raw.get("evaluation", {}), raw.get("images", {})
    chosen = []
    for kind in _PREFIXES:  # strategies run in this order, of one kind in that of the file
        for key, s in raw.get("algorithms", {}).items():
            if key.startswith(kind) and not any(key.startswith(k) for k in _PREFIXES if len(k) > len(kind)):
                more = {a: s[b] for a, b in (("n", "num_partitions"), ("digits", "hash_digits")) if b in s}
                chosen.append(Strategy(_PREFIXES[kind], s.get("name", key), s.get("batch_size", 1000), s.get("thread_count", 1), s.get("max_retries", 0), more))
    base = Config()
    return Config(
        data.get("input", {}).get("text_dir", base.text_dir), data.get("input", {}).get("images_dir", base.images_dir), data.get("output", base.output),
        raw.get("spacy", {}).get("model", base.model), images.get("model", base.image_model), tuple(images.get("labels", base.image_labels)), raw.get("hub", base.hub), evaluation.get("enabled", base.evaluate), tuple(evaluation.get("scenarios", base.scenarios)),
        evaluation.get("runs_per_algorithm", base.runs), evaluation.get("output_dir", base.results), raw.get("store", base.store), tuple(chosen) or STRATEGIES,
    )


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_mapping(yaml.safe_load(f) or {})
