"""Source trees and histories written for the tests: a small parcel-shipping system."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

LICENCE = "# Copyright the authors.\n# SPDX-License-Identifier: MIT\n"

PYTHON = {
    "shipping/tariff.py": LICENCE + '''"""Parcel tariffs."""

from domain.parcel import Parcel, Zone

BASE_FEE = 4


class Tariff:
    """Prices parcels."""

    def quote(self, parcel: Parcel, zone: Zone) -> int:
        """Price of one parcel for a zone."""
        check(parcel)
        return self.surcharge(parcel) + BASE_FEE

    def surcharge(self, parcel: Parcel) -> int:
        return oversize_fee(parcel.weight)


def oversize_fee(weight: int) -> int:
    """Extra fee for heavy parcels."""
    if weight > 30:
        return 12
    return 0


def check(parcel):
    if parcel.weight <= 0:
        raise ValueError("weight")
''',
    "domain/parcel.py": '''"""What is shipped."""

from enum import Enum


class Zone(Enum):
    NEAR = "near"
    FAR = "far"


class Parcel:
    weight: int

    def volume(self):
        return self.weight * 2
''',
    "desk/counter.py": '''from shipping.tariff import Tariff


def accept(parcel):
    """A clerk accepts a parcel and quotes its price."""
    tariff = Tariff()
    return tariff.quote(parcel, None)


def check(form):
    return bool(form)
''',
    "desk/app.py": '''from desk.counter import accept


def main():
    return accept(None)
''',
    "config/fees.yaml": "base: 4\nheavy: 12\n",
    "tests/test_tariff.py": '''from shipping.tariff import oversize_fee, Tariff


def test_oversize_fee():
    assert oversize_fee(40) == 12


def test_quote_runs():
    t = Tariff()
    t.quote(None, None)


def test_check():
    assert True
''',
    "build/generated.py": "def ignored():\n    return 1\n",
    ".gitignore": "*.log\nsecret/\n!keep.log\n",
    "secret/hidden.py": "def hidden():\n    pass\n",
    "web/bundle.min.js": "function x(){}\n",
    "empty.py": "",
    "README.md": "# readme\n",
}

TYPESCRIPT = {
    "src/tariff.ts": '''// SPDX-License-Identifier: MIT

import {
  Parcel,
  Zone,
} from "./parcel";

export const FEES = { heavy: 12 };

export class Tariff {
  constructor(private readonly zone: Zone) {}

  quote(parcel: Parcel): number {
    return oversizeFee(parcel.weight);
  }
}

export function oversizeFee(weight: number): number {
  return weight > 30 ? FEES.heavy : 0;
}
''',
    "src/parcel.ts": '''/** A thing to ship. */
export interface Parcel {
  weight: number;
}

export enum Zone { Near, Far }
''',
    "tests/tariff.test.ts": '''import { oversizeFee } from "../src/tariff";

test("heavy parcels cost more", () => {
  expect(oversizeFee(40)).toBe(12);
});
''',
}


def write_tree(root: Path, files: dict[str, str]) -> Path:
    for name, text in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
    return root


def git(cwd: Path, *args: str, when: str | None = None) -> None:
    env = dict(os.environ, GIT_CONFIG_GLOBAL="/dev/null", GIT_CONFIG_SYSTEM="/dev/null")
    if when:
        env |= {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@example.invalid", *args], cwd=cwd, check=True,
                   capture_output=True, env=env)


def commit_together(root: Path, names: list[str], times: int, first_day: int = 1) -> None:
    """`times` weekly commits that each touch all of `names`."""
    for i in range(times):
        for name in names:
            mark = "#" if name.endswith((".py", ".yaml")) else "//"
            path = root / name
            body = path.read_text().split(f"\n{mark} revision")[0].rstrip("\n")
            path.write_text(f"{body}\n{mark} revision {first_day}-{i}\n")
        git(root, "add", "-A")
        git(root, "commit", "-q", "-m", f"change {i}", when=f"2026-0{1 + i // 4}-{first_day + 7 * (i % 4):02d}T10:00:00+02:00")
