"""A Grounder around a generative model: a task prompt before the query, generation, and parsing of what comes out."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import OutputError, SettingsError
from .grounding import size

#: What asks a model of this kind for the boxes of a phrase (a fixed value).
TASK = "<CAPTION_TO_PHRASE_GROUNDING>"


class Backend(Protocol):
    """A loaded model with its processor."""

    def generate(self, *, image: bytes, prompt: str, **options: Any) -> str: ...

    def parse(self, raw: str, *, task: str, image_size: tuple[int, int]) -> dict[str, Any]:
        """{task: {"bboxes": pixel boxes, "labels": their labels}}."""


def prompt_for(query: str | Column, task: str = TASK) -> str | Column:
    """The query as it stands, right behind the task; of a column a column."""
    return F.concat(F.lit(task), query) if isinstance(query, Column) else task + query


def candidates(parsed: Any, task: str = TASK) -> dict[str, list]:
    """boxes and labels (one a box, empty where there is none) of a parsed output; OutputError if it cannot be used."""
    result = parsed.get(task) if isinstance(parsed, dict) else None
    if not isinstance(result, dict):
        raise OutputError("no result of the task")
    boxes, labels = result.get("bboxes"), result.get("labels") or []
    if not isinstance(boxes, list) or not boxes:
        raise OutputError("no_candidates")
    out = []
    for i, box in enumerate(boxes):
        if not isinstance(box, (list, tuple)) or len(box) != 4:
            raise OutputError(f"box {i + 1} has no four coordinates")
        try:
            out.append([float(v) for v in box])
        except (TypeError, ValueError):
            raise OutputError(f"box {i + 1} has a coordinate that is no number") from None
    return {"boxes": out, "labels": [str(labels[i]) if i < len(labels) else "" for i in range(len(out))]}


class PromptedGrounder:
    """backend names what loads the model, as module:callable; it is called with model_path and load_options by load(), or at
    the first image. options go to every generation."""

    def __init__(self, backend: str, model_path: str, task: str = TASK, load_options: dict[str, Any] | None = None, **options: Any) -> None:
        if not Path(model_path).exists():
            raise SettingsError(f"no model at {model_path}")
        self.backend, self.model_path, self.task = backend, model_path, task
        self.load_options, self.options, self.loaded = load_options or {}, options, None

    def model(self) -> Backend:
        if self.loaded is None:
            module, _, name = self.backend.partition(":")
            self.loaded = getattr(importlib.import_module(module), name)(self.model_path, **self.load_options)
        return self.loaded

    def load(self) -> None:
        self.model()

    def peak_memory(self) -> int:
        """Bytes of its device that the model has held at most: what the backend says, or the GPU's where one is in use."""
        if hasattr(self.loaded, "peak_memory"):
            return int(self.loaded.peak_memory())
        torch = sys.modules.get("torch")
        return int(torch.cuda.max_memory_allocated()) if torch is not None and torch.cuda.is_available() else 0

    def predict(self, *, image: bytes, query: str) -> dict[str, Any]:
        raw = self.model().generate(image=image, prompt=prompt_for(query, self.task), **self.options)
        return {"raw_output": raw} | candidates(self.model().parse(raw, task=self.task, image_size=size(image)), self.task)
