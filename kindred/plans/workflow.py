"""A step runner that commits to every input and output and stops at the first blocked step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from kindred.operators.ledger import canonical_json, sha256_text


class StepFailed(RuntimeError):
    """A step raised; the completed prefix is kept."""

    def __init__(self, name: str, done: list[Done]):
        super().__init__(f"step {name} failed")
        self.done = done


@dataclass(frozen=True)
class Done:
    name: str
    status: str
    input_sha256: str
    output_sha256: str
    output: Any = field(compare=False, default=None)


def run(steps: list[tuple[str, Callable[[dict], tuple[str, dict]]]], context: dict, prefix: list[Done] = ()) -> list[Done]:
    """Run (name, step) in order; a step gets what came before and returns (COMPLETED or BLOCKED, output).

    prefix: results of an earlier run, taken over as long as their commitments agree with the same inputs.
    """
    done: list[Done] = []
    state = dict(context)
    for i, (name, step) in enumerate(steps):
        key = sha256_text(canonical_json([name, state]))
        if i < len(prefix) and prefix[i].name == name and prefix[i].input_sha256 == key and prefix[i].status == "COMPLETED":
            if sha256_text(canonical_json(prefix[i].output)) != prefix[i].output_sha256:
                raise ValueError(f"stored output of {name} was changed")
            result = prefix[i]
        else:
            try:
                status, output = step(state)
            except Exception as e:
                raise StepFailed(name, done) from e
            if status not in ("COMPLETED", "BLOCKED"):
                raise ValueError(f"{name}: unknown status {status}")
            result = Done(name, status, key, sha256_text(canonical_json(output)), output)
        done.append(result)
        if result.status == "BLOCKED":
            break
        state = state | {name: result.output}
    return done
