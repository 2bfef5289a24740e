"""python -m tidemark.plans.rulecheck [--format] [--lists FILE] RULES: errors and warnings of a rule file, or its canonical text."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tidemark.plans.checking import Scope, load_rules, parse_lists
from tidemark.plans.language import RuleError


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("rules")
    parser.add_argument("--lists")
    parser.add_argument("--format", action="store_true", help="print each rule in canonical text")
    given = parser.parse_args(args)
    scope = Scope(lists=parse_lists(Path(given.lists).read_text()) if given.lists else {})
    try:
        rules, problems = load_rules(Path(given.rules).read_text(), scope)
    except RuleError as e:
        print(e)
        return 1
    if given.format:
        print("\n".join(r.text for r in rules))
    else:
        print("\n\n".join(p.render() for p in problems) or f"{len(rules)} rules, nothing to report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
