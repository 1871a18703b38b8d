"""Validation of proposed changes: rules in order, each with what must hold before it runs, and one status a candidate.

A candidate is one JSON document: version, proposed files (path, action, content), references to evidence. A rule is an expression over the candidate's row,
so any number of rules is one narrow stage; only the evidence is joined. A rule whose needs have failed for a candidate is not run for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import nested
from tracewell.functions.source_lines import source_family, source_type

# Severities from the gravest, actions, extensions, limits, names of devices, codes that make a status.
SEVERITIES = ("blocking", "error", "warning", "info")
ACTIONS = ("create", "modify", "delete", "rename")
EXTENSIONS = (".rpgle", ".sqlrpgle", ".rpg", ".clle", ".clp", ".pf", ".lf", ".dspf", ".prtf", ".sql", ".bnd", ".txt", ".md", ".json")
MAX_FILES, MAX_BYTES, MAX_TOTAL_BYTES = 32, 256 * 1024, 1024 * 1024
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{n}{k}" for n in ("COM", "LPT") for k in range(1, 10)))
STATUSES = (
    ("internal-validator-failure", ("VALIDATOR_INTERNAL",)), ("denied", ("POLICY_DENIED", "SECRET_LIKE_CONTENT")), ("invalid", ("SCHEMA_INVALID", "CONTRACT_VERSION_UNSUPPORTED")), ("unsupported", ("STATIC_PARSE_UNSUPPORTED",)),
)
_FOUND = "array<struct<code:string,severity:string,path:string>>"


@dataclass(frozen=True)
class Policy:
    """What a run allows: the folders that files may lie in (any, where none are named), a reason to deny everything, and the limits."""

    scope: tuple[str, ...] = ()
    deny: str | None = None
    extensions: tuple[str, ...] = EXTENSIONS
    max_files: int = MAX_FILES
    max_bytes: int = MAX_BYTES
    max_total_bytes: int = MAX_TOTAL_BYTES


@dataclass(frozen=True)
class Rule:
    """check(candidate columns, policy) gives an array of (code, severity, path); needs are rules that must not have failed."""

    id: str
    order: int
    check: Callable[[Mapping[str, Column], Policy], Column]
    version: int = 1
    needs: tuple[str, ...] = ()


def _one(test: Column, code: str, path: Column | str | None = None, severity: str = "blocking") -> Column:
    where = path if isinstance(path, Column) else F.lit(path).cast("string")
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), where.alias("path")))).otherwise(F.array()).cast(_FOUND)


def _each(items: Column, test: Callable[[Column], Column], code: str, path: Callable[[Column], Column] = lambda f: f["path"]) -> Column:
    return F.transform(F.filter(items, lambda f: F.coalesce(test(f), F.lit(False))), lambda f: F.struct(F.lit(code).alias("code"), F.lit("blocking").alias("severity"), path(f).alias("path"))).cast(_FOUND)


def _plain(path: Column) -> Column:
    """Slashes one way, without steps that stay in place."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(path, r"\\", "/")), r"(^|/)(\./)+", "$1"), "/+", "/")


def unsafe_path(path: Column) -> Column:
    """Empty, with control characters, from the root, a share or a drive, with a step to the parent, or with a device's name."""
    steps = F.split(_plain(path), "/")
    device = F.exists(steps, lambda s: F.upper(F.get(F.split(s, r"\."), 0)).isin(*DEVICES))
    rooted = path.startswith("/") | path.startswith("\\") | path.rlike("^[A-Za-z]:")
    return path.isNull() | (F.trim(path) == "") | path.rlike(r"[\x00-\x1F\x7F]") | rooted | F.array_contains(steps, "..") | device


def _schema(c: Mapping[str, Column], _: Policy) -> Column:
    files = nested.at(c["v"], "proposedFiles", "array<variant>")
    whole = nested.members(c["v"]).isNotNull()
    unnamed = F.exists(files, lambda f: nested.at(f, "path", "string").isNull())
    return F.concat(
        _one(~whole | c["v"].isNull(), "SCHEMA_INVALID", "/"), _one(whole & (F.coalesce(nested.at(c["v"], "candidateId", "string"), F.lit("")) == ""), "SCHEMA_INVALID", "/candidateId"),
        _one(whole & (files.isNull() | (F.size(files) == 0)), "SCHEMA_INVALID", "/proposedFiles"), _one(whole & unnamed, "SCHEMA_INVALID", "/proposedFiles/path"),
    )


def _contract(c: Mapping[str, Column], _: Policy) -> Column:
    return _one(~nested.at(c["v"], "schemaVersion", "double").eqNullSafe(F.lit(1.0)), "CONTRACT_VERSION_UNSUPPORTED", "/schemaVersion")


def _paths(c: Mapping[str, Column], _: Policy) -> Column:
    return _each(c["files"], lambda f: unsafe_path(f["path"]), "PATH_UNSAFE")


def _types(c: Mapping[str, Column], p: Policy) -> Column:
    ending = lambda f: F.lower(F.regexp_extract(F.element_at(F.split(_plain(f["path"]), "/"), -1), r"^.+(\.[^.]*)$", 1))
    return _each(c["files"], lambda f: ~ending(f).isin(*p.extensions), "FILE_TYPE_DENIED")


def _sizes(c: Mapping[str, Column], p: Policy) -> Column:
    size = lambda f: F.octet_length(F.coalesce(f["content"], F.lit("")))
    total = F.aggregate(c["files"], F.lit(0).cast("long"), lambda s, f: s + size(f))
    return F.concat(_one(F.size(c["files"]) > p.max_files, "TOO_MANY_FILES", "/proposedFiles"), _each(c["files"], lambda f: size(f) > p.max_bytes, "CONTENT_TOO_LARGE"), _one(total > p.max_total_bytes, "TOTAL_CONTENT_TOO_LARGE", "/proposedFiles"))


def _targets(c: Mapping[str, Column], _: Policy) -> Column:
    names = F.transform(c["files"], lambda f: F.lower(_plain(f["path"])))
    again = F.transform(c["files"], lambda f, i: F.struct(f["path"].alias("path"), ((F.get(names, i) != "") & (F.array_position(names, F.get(names, i)) <= i)).alias("again")))
    return _each(again, lambda f: f["again"], "DUPLICATE_TARGET")


def _scope(c: Mapping[str, Column], p: Policy) -> Column:
    if not p.scope:
        return F.array().cast(_FOUND)
    inside = lambda f: F.exists(F.array(*(F.lit(r.strip("/")) for r in p.scope)), lambda r: (_plain(f["path"]) == r) | _plain(f["path"]).startswith(F.concat(r, F.lit("/"))))
    more = nested.at(c["v"], "additionalFiles", "array<variant>")
    return F.concat(_each(c["files"], lambda f: ~inside(f), "SCOPE_EXPANSION", lambda f: _plain(f["path"])), _one(more.isNotNull(), "UNDECLARED_FILE", "/additionalFiles"))


def _evidence(c: Mapping[str, Column], _: Policy) -> Column:
    where = lambda r: F.concat(F.lit("/evidenceReferences/"), F.coalesce(r["id"], F.lit("")))
    known = lambda r: F.try_element_at(c["known"], F.coalesce(r["id"], F.lit("")))
    return F.concat(
        _one(F.size(c["references"]) == 0, "EVIDENCE_MISSING", "/evidenceReferences"), _each(c["references"], lambda r: known(r).isNull(), "EVIDENCE_UNKNOWN", where),
        _each(c["references"], lambda r: (r["kind"] != known(r)) & (known(r) != ""), "EVIDENCE_TYPE_MISMATCH", where),
    )


def _policy(c: Mapping[str, Column], p: Policy) -> Column:
    secret = lambda f: f["content"].rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----") | f["content"].rlike(r"(?i)(?:password|secret|api[_-]?key|token)\s*[:=]\s*['\"][^'\"]{8,}")
    action = lambda f: ~F.coalesce(F.when(f["action"] != "", f["action"]), F.lit("modify")).isin(*ACTIONS)
    return F.concat(_one(F.lit(p.deny is not None), "POLICY_DENIED"), _each(c["files"], secret, "SECRET_LIKE_CONTENT"), _each(c["files"], action, "POLICY_DENIED"))


def _static(c: Mapping[str, Column], _: Policy) -> Column:
    source = lambda f: source_family(source_type(f["path"])).isin("RPG", "CL", "DDS")
    return _each(c["files"], lambda f: ~f["action"].eqNullSafe("delete") & source(f) & f["content"].contains("\x00"), "STATIC_PARSE_FAILED")


_LATER = ("schema",)
BUILT_IN = (
    Rule("schema", 10, _schema), Rule("contract-version", 20, _contract, needs=_LATER), Rule("workspace-path", 30, _paths, needs=_LATER), Rule("file-type", 40, _types, needs=_LATER), Rule("size-limits", 50, _sizes, needs=_LATER),
    Rule("duplicate-target", 60, _targets, needs=_LATER), Rule("scope", 70, _scope, needs=(*_LATER, "workspace-path")), Rule("evidence-reference", 80, _evidence, needs=_LATER), Rule("policy", 90, _policy, needs=_LATER),
    Rule("static-parse", 100, _static, needs=(*_LATER, "file-type")),
)


@dataclass
class Registry:
    """Rules by id. A rule can only need rules of a lower order, so there are no cycles; ids are unique."""

    required: tuple[str, ...] = tuple(r.id for r in BUILT_IN)
    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, *rules: Rule) -> Registry:
        for rule in rules:
            if not rule.id or rule.id in self.rules:
                raise ValueError(f"a rule needs an id of its own: {rule.id!r}")
            if rule.version < 1:
                raise ValueError(f"version of {rule.id} must be 1 or more")
            self.rules[rule.id] = rule
        for rule in self.rules.values():
            for need in rule.needs:
                if need not in self.rules or self.rules[need].order >= rule.order:
                    raise ValueError(f"{rule.id} needs {need}, which must be registered with a lower order")
        return self

    def ordered(self) -> list[Rule]:
        return sorted(self.rules.values(), key=lambda r: (r.order, r.id))


def default_registry() -> Registry:
    return Registry().register(*BUILT_IN)


def _tagged(rule: Rule) -> Callable[[Column], Column]:
    return lambda d: F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.version).alias("version"), d["code"], d["severity"], d["path"])


def _read(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """candidates with v, files, references and known, a map from the ids of evidence that a candidate refers to, to its kind."""
    text = lambda v, k: nested.at(v, k, "string").alias(k)
    listed = lambda k, *fields: F.transform(F.coalesce(nested.at(F.col("v"), k, "array<variant>"), F.array().cast("array<variant>")), lambda f: F.struct(*(text(f, x) for x in fields)))
    rows = candidates.select("id", nested.parsed(F.col("document")).alias("v")).withColumns({"files": listed("proposedFiles", "path", "action", "content"), "references": listed("evidenceReferences", "id", "kind")})
    asked = rows.select("id", F.explode("references").alias("r")).select("id", F.col("r.id").alias("ref")).distinct()
    stored = evidence.groupBy(F.col("id").alias("ref")).agg(F.min(F.coalesce("kind", F.lit(""))).alias("kind"))
    known = asked.join(stored, "ref").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "kind"))).alias("known"))  # bounded by a document's references
    return rows.join(known, "id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))


def validate(candidates: DataFrame, evidence: DataFrame, policy: Policy = Policy(), registry: Registry | None = None) -> DataFrame:
    """candidates(id, document) and evidence(id, kind) -> id, status, ready, ran (rules run for it, in order), diagnostics (array of rule, version, code,
    severity, path; gravest first, then code and path).

    A null or broken document fails the schema and nothing else is run for it. A required rule that is missing is a VALIDATOR_MISSING of every candidate; one
    that cannot be built is VALIDATOR_INTERNAL, and the others still run. (id) is a key."""
    registry = registry or default_registry()
    rows = _read(candidates, evidence)
    columns = {c: F.col(c) for c in ("v", "files", "references", "known")}
    tag = "array<struct<rule:string,version:int,code:string,severity:string,path:string>>"
    parts, failed, ran = [], {}, []
    for missing in (r for r in registry.required if r not in registry.rules):
        parts.append(F.array(F.struct(F.lit("registry"), F.lit(1), F.lit("VALIDATOR_MISSING"), F.lit("blocking"), F.lit(missing))).cast(tag))
    for number, rule in enumerate(registry.ordered()):
        try:
            found = rule.check(columns, policy)
        except Exception:  # a rule's own fault must not keep others from running; what it was is not shown
            found = _one(F.lit(True), "VALIDATOR_INTERNAL")
        open_ = F.lit(True)
        for need in rule.needs:
            open_ = open_ & ~failed[need]
        name = f"rule_{number}"
        rows = rows.withColumn(name, F.when(open_, found.cast(_FOUND)))
        failed[rule.id] = F.coalesce(F.exists(name, lambda d: d["severity"].isin("blocking", "error")), F.lit(True))
        ran.append(F.when(F.col(name).isNotNull(), F.lit(rule.id)))
        parts.append(F.transform(F.coalesce(F.col(name), F.array().cast(_FOUND)), _tagged(rule)).cast(tag))
    every = F.concat(*parts) if parts else F.array().cast(tag)
    grade = F.array(*map(F.lit, SEVERITIES))
    keyed = F.transform(every, lambda d: F.struct(F.array_position(grade, d["severity"]).alias("g"), d["code"].alias("c"), F.coalesce(d["path"], F.lit("")).alias("p"), d.alias("d")))
    rows = rows.select("id", F.array_compact(F.array(*ran)).alias("ran") if ran else F.array().cast("array<string>").alias("ran"), F.transform(F.array_sort(keyed), lambda k: k["d"]).alias("diagnostics"))
    has = lambda codes: F.exists("diagnostics", lambda d: d["code"].isin(*codes))
    status = F.when(F.lit(False), "")
    for name, codes in STATUSES:
        status = status.when(has(codes), name)
    status = status.when(F.exists("diagnostics", lambda d: d["severity"].isin("blocking", "error")), "validation-failed").otherwise("review-ready")
    return rows.select("id", status.alias("status"), (status == "review-ready").alias("ready"), "ran", "diagnostics")
