"""Settings, with dotted overrides."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class JudgeConfig:
    extractor_prompt: str = "extractor"
    matcher_prompt: str = "matcher"
    model: str = ""
    target_usd: float = 10.0
    hard_stop_usd: float = 12.0
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for model, prices in self.rates.items():
            if min(prices) < 0:
                raise ValueError(f"negative price for {model}")


@dataclass
class Config:
    tasks: str = ""
    judge: JudgeConfig = field(default_factory=JudgeConfig)

    def override(self, path: str, value) -> Config:
        """Sets e.g. judge.model; unknown names are errors."""
        at, *names = self, *path.split(".")
        for name in names[:-1]:
            at = getattr(at, name)
        if not is_dataclass(at) or names[-1] not in {f.name for f in fields(at)}:
            raise KeyError(path)
        setattr(at, names[-1], value)
        return self
