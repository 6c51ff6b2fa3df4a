"""Column names of a signal frame: one row per (worker, time step)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

OPTIONAL_CHANNELS = ("resp", "accel")

# Our name, the place of its setting in a configuration, and the column it names by default. Two of
# them name several columns.
COLUMNS = {
    "timestamp": ("features.timestamp", "timestamp"),
    "time_idx": ("features.time_idx", "time_idx"),
    "worker": ("features.worker_id", "worker_id"),
    "stress": ("targets.stress.label_col", "y_stress"),
    "comfort": ("targets.comfort.label_col", "y_comfort_proxy"),
    "protocol": ("features.protocol_label", "protocol_label"),
    "physiology": ("features.physiology", ("ecg", "eda", "temp")),
    "context": ("features.robot_context", ("distance_to_robot", "robot_speed")),
    "hazard": ("features.optional.hazard_zone", "hazard_zone"),
    "phase": ("features.optional.task_phase", "task_phase"),
    "specialization": ("features.optional.specialization_col", "specialization_index"),
    "experience": ("features.optional.experience_col", "experience_level"),
}
USE_CONTEXT = "features.use_robot_context"


def setting(cfg: Mapping, path: str, default):
    """The value at a dotted path of nested mappings."""
    for key in path.split("."):
        if not isinstance(cfg, Mapping) or key not in cfg:
            return default
        cfg = cfg[key]
    return cfg


class SignalSchema:
    """One attribute per entry of COLUMNS; entries that aren't given keep their default."""

    def __init__(self, **names: str | Iterable[str]):
        unknown = sorted(set(names) - set(COLUMNS))
        if unknown:
            raise TypeError(f"unknown columns: {unknown}")
        for name, (_, default) in COLUMNS.items():
            value = names.get(name, default)
            setattr(self, name, tuple(value) if isinstance(default, tuple) else value)

    @classmethod
    def from_config(cls, cfg: Mapping) -> SignalSchema:
        chosen = {name: setting(cfg, path, default) for name, (path, default) in COLUMNS.items()}
        return cls(**chosen if setting(cfg, USE_CONTEXT, True) else chosen | {"context": ()})

    @property
    def signals(self) -> tuple[str, ...]:
        """Physiology then robot context: the channels every stage treats alike."""
        return self.physiology + self.context

    def required(self) -> list[str]:
        """Columns without which no stage can run."""
        single = (name for name in ("timestamp", "time_idx", "worker", "stress", "comfort"))
        return [*(getattr(self, name) for name in single), *self.physiology]

    def fillable(self, columns: Iterable[str]) -> list[str]:
        """Channels that gap filling covers: the signals plus whichever extra channels are present."""
        present = set(columns)
        extra = [c for c in OPTIONAL_CHANNELS if c in present and c not in self.signals]
        return [*self.signals, *extra]

    def channels(self, columns: Iterable[str]) -> list[str]:
        """Window channel order: signals, extra channels, hazard zone."""
        present = set(columns)
        tail = [self.hazard] if self.hazard in present else []
        return [*self.fillable(present), *tail]

    def require(self, columns: Iterable[str], names: Iterable[str] | None = None) -> None:
        missing = sorted(set(self.required() if names is None else names) - set(columns))
        if missing:
            raise ValueError(f"missing required columns: {missing}")
