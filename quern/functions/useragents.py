"""What a browser says of itself, by rules in the format of uap-core [github.com/ua-parser/uap-core]."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..dialect.lexer import QueryError
from ..plans.values import Atom, Row

try:
    import yaml
except ImportError:  # rules then come as JSON
    yaml = None

#: Rules that are used where no file is named; a few families only.
RULES = {
    "user_agent_parsers": [
        {"regex": r"(Googlebot|bingbot|YandexBot|DuckDuckBot)/(\d+)(?:\.(\d+))?"},
        {"regex": r"(Edg)(?:e|A|iOS)?/(\d+)(?:\.(\d+))?(?:\.(\d+))?", "family_replacement": "Edge"},
        {"regex": r"(OPR)/(\d+)(?:\.(\d+))?(?:\.(\d+))?", "family_replacement": "Opera"},
        {"regex": r"(Firefox)/(\d+)(?:\.(\d+))?(?:\.(\d+))?", "family_replacement": "Firefox"},
        {"regex": r"Android.* (Chrome)/(\d+)(?:\.(\d+))?(?:\.(\d+))?", "family_replacement": "Chrome Mobile"},
        {"regex": r"(Chrome)/(\d+)(?:\.(\d+))?(?:\.(\d+))?", "family_replacement": "Chrome"},
        {"regex": r"(?:iPhone|iPad|iPod).* (Version)/(\d+)(?:\.(\d+))?(?:\.(\d+))?.* Safari", "family_replacement": "Mobile Safari"},
        {"regex": r"(Version)/(\d+)(?:\.(\d+))?(?:\.(\d+))?.* Safari", "family_replacement": "Safari"},
    ],
    "os_parsers": [
        {"regex": r"(Windows NT) (\d+)\.(\d+)", "os_replacement": "Windows"},
        {"regex": r"(Android)[ -](\d+)(?:\.(\d+))?(?:\.(\d+))?"},
        {"regex": r"(iPhone|iPad|iPod).* OS (\d+)_(\d+)(?:_(\d+))?", "os_replacement": "iOS"},
        {"regex": r"(Mac OS X) (\d+)[_.](\d+)(?:[_.](\d+))?"},
        {"regex": r"(Linux)"},
    ],
    "device_parsers": [
        {"regex": r"Googlebot|bingbot|YandexBot|DuckDuckBot", "device_replacement": "Spider", "brand_replacement": "Spider", "model_replacement": "Desktop"},
        {"regex": r"(iPhone|iPad|iPod)", "device_replacement": "$1", "brand_replacement": "Apple", "model_replacement": "$1"},
    ],
}
#: Names of a rule's replacements, by what it tells; fixed values.
BROWSER = ("family_replacement", "v1_replacement", "v2_replacement", "v3_replacement")
SYSTEM = ("os_replacement", "os_v1_replacement", "os_v2_replacement", "os_v3_replacement")
DEVICE = ("device_replacement", "brand_replacement", "model_replacement")


class Parser:
    """Rules in order; the first that matches tells.  Agents that were seen lately are remembered."""

    def __init__(self, rules: dict[str, list[dict]]):
        self.rules = {kind: [(re.compile(r["regex"], re.I if r.get("regex_flag") == "i" else 0), r) for r in rules.get(kind) or []] for kind in ("user_agent_parsers", "os_parsers", "device_parsers")}
        self.of = lru_cache(100_000)(self._of)

    def _match(self, kind: str, agent: str) -> tuple[re.Match, dict] | None:
        for pattern, rule in self.rules[kind]:
            m = pattern.search(agent)
            if m:
                return m, rule
        return None

    def _software(self, kind: str, names: tuple[str, ...], agent: str) -> tuple[str, str]:
        """Family and version; groups tell what the rule does not, the first one the family."""
        found = self._match(kind, agent)
        if not found:
            return "Other", "0.0.0"
        m, rule = found
        parts = []
        for i, name in enumerate(names, 1):
            own = m.group(i) if i <= m.re.groups else None
            parts.append(filled(rule[name], m) if rule.get(name) is not None else own or "")
        return parts[0] or "Other", ".".join(x or "0" for x in parts[1:])

    def _of(self, agent: str) -> dict:
        browser, system = self._software("user_agent_parsers", BROWSER, agent), self._software("os_parsers", SYSTEM, agent)
        found = self._match("device_parsers", agent)
        family, brand, model = "Other", None, None
        if found:
            m, rule = found
            first = m.group(1) if m.re.groups else None
            family, brand, model = (filled(rule[n], m) if rule.get(n) is not None else None for n in DEVICE)
            family, model = family or first or "Other", model or first
        return {"browser": browser[0], "browser_version": browser[1], "system": system[0], "system_version": system[1], "brand": brand or "", "model": model or "", "spider": int(family == "Spider")}


def filled(text: str, m: re.Match) -> str:
    """A replacement with $1 and so on filled in."""
    return re.sub(r"\$(\d)", lambda d: (m.group(int(d[1])) or "") if int(d[1]) <= m.re.groups else "", str(text)).strip()


def rules_of(spark, path: str) -> dict[str, list[dict]]:
    """A file of rules, as YAML or JSON, from any file system that Spark reads."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if text.lstrip().startswith("{"):
        return json.loads(text)
    if yaml is None:
        raise QueryError("rules as YAML need the module yaml; give them as JSON")
    return yaml.safe_load(text)


KIND = T.StructType([T.StructField(n, T.StringType()) for n in ("browser", "browser_version", "system", "system_version", "brand", "model")] + [T.StructField("spider", T.IntegerType())])


def user_agent(engine, regexFile: str | None = None):  # noqa: N803
    """Browser, system and device of an agent; without a file of rules, of a few families."""
    parser = Parser(rules_of(engine.spark, regexFile) if regexFile else RULES)
    rules = {kind: [rule for _, rule in pairs] for kind, pairs in parser.rules.items()}
    cell: list[Parser] = []

    @pandas_udf(KIND)
    def parse(agents: pd.Series) -> pd.DataFrame:
        if not cell:
            cell.append(Parser(rules))
        nothing = dict.fromkeys(KIND.names)
        return pd.DataFrame([nothing if a is None else cell[0].of(a) for a in agents], columns=KIND.names).astype({"spider": "Int32"})

    def apply(scope, args):
        given = args[0].fields["ua"] if isinstance(args[0], Row) else args[0]
        told = parse(given.column().cast("string"))
        return Row({
            "browser": Row({"family": Atom(told["browser"]), "version": Atom(told["browser_version"])}), "os": Row({"family": Atom(told["system"]), "version": Atom(told["system_version"])}),
            "device": Row({"brand": Atom(told["brand"]), "model": Atom(told["model"])}), "isSpider": Atom(told["spider"]),
        })

    return apply
