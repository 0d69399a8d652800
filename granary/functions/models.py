"""Registered models: tables that callers query as views, each with what a caller's permissions show of it and let it do."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.control import granted

ACTIONS = ("list", "get", "create", "update", "delete")
#: Permissions of a caller that are collected; more are an error, as a predicate is written for each.
MOST_PERMISSIONS = 10_000


@dataclass(frozen=True)
class Model:
    """A table by its key. needs: by action the permissions of which one is asked for (none: any caller may, an action that is
    None: no caller may). visible: by permission which rows it shows; a caller sees what any of its permissions shows, and all
    rows where none is named. Columns in `hidden` are never shown, those in `readonly` never written."""

    rows: DataFrame
    key: str
    hidden: tuple[str, ...] = ()
    readonly: tuple[str, ...] = ()
    needs: dict[str, tuple[str, ...] | None] = field(default_factory=dict)
    visible: dict[str, str | Column] = field(default_factory=dict)


def permission_codes(roles: DataFrame, grants: DataFrame, permissions: DataFrame, code: str = "code") -> set[str]:
    """The codes of the enabled permissions of roles."""
    rows = granted(roles, grants, permissions).select(code).distinct().limit(MOST_PERMISSIONS + 1).collect()
    if len(rows) > MOST_PERMISSIONS:
        raise ValueError(f"more than {MOST_PERMISSIONS} permissions")
    return {r[0] for r in rows if r[0] is not None}


class Models:
    """Models by name, each once."""

    def __init__(self) -> None:
        self._known: dict[str, Model] = {}

    def register(self, name: str, model: Model) -> None:
        if name in self._known:
            raise ValueError(f"model {name} is registered already")
        unknown = ({model.key, *model.hidden, *model.readonly} - set(model.rows.columns)) | (set(model.needs) - set(ACTIONS))
        if unknown:
            raise ValueError(f"unknown columns or actions {sorted(unknown)}")
        self._known[name] = model

    def get(self, name: str) -> Model:
        if name not in self._known:
            raise ValueError(f"no model {name}; there are {sorted(self._known)}")
        return self._known[name]

    def may(self, name: str, action: str, permissions: Collection[str]) -> bool:
        needs = self.get(name).needs.get(action, ())
        return needs is not None and (not needs or any(p in permissions for p in needs))

    def _checked(self, name: str, action: str, permissions: Collection[str]) -> Model:
        if not self.may(name, action, permissions):
            raise PermissionError(f"{action} of {name}")
        return self.get(name)

    def _rows(self, model: Model, permissions: Collection[str]) -> DataFrame:
        """The rows that permissions show, all columns."""
        if not model.visible:
            return model.rows
        shown = [F.expr(c) if isinstance(c, str) else c for p, c in sorted(model.visible.items()) if p in permissions]
        return model.rows.filter(F.coalesce(reduce(Column.__or__, shown, F.lit(False)), F.lit(False)) if len(shown) != 1 else shown[0])

    def listed(self, name: str, permissions: Collection[str]) -> DataFrame:
        """What a caller sees of a model; the predicate stands below any filter that comes later, and goes to the scan with it."""
        model = self._checked(name, "list", permissions)
        return self._rows(model, permissions).drop(*model.hidden)

    def got(self, name: str, permissions: Collection[str], key) -> DataFrame:
        model = self._checked(name, "get", permissions)
        return self._rows(model, permissions).filter(F.col(model.key) == F.lit(key)).drop(*model.hidden)

    def views(self, spark: SparkSession, permissions: Collection[str]) -> SparkSession:
        """A session of the caller's own, in which each model that it may list is a view; others can't be named there."""
        session = spark.newSession()
        for name in sorted(self._known):
            if self.may(name, "list", permissions):
                _into(session, name, self.listed(name, permissions))
        return session

    def created(self, name: str, permissions: Collection[str], new: DataFrame) -> DataFrame:
        """The model's rows with new ones; those whose key is there already are left out, columns not given are null."""
        model = self._checked(name, "create", permissions)
        self._writable(model, new)
        fresh = new.filter(F.col(model.key).isNotNull()).dropDuplicates([model.key]).join(model.rows.select(model.key), model.key, "left_anti")
        return model.rows.unionByName(fresh, allowMissingColumns=True)

    def updated(self, name: str, permissions: Collection[str], changes: DataFrame) -> DataFrame:
        """The model's rows with the given columns of `changes` in place, only where the caller sees the row; one change a key."""
        model = self._checked(name, "update", permissions)
        self._writable(model, changes)
        seen = self._rows(model, permissions).select(model.key)
        columns = [c for c in changes.columns if c != model.key]
        own = changes.join(seen, model.key, "left_semi").select(model.key, F.struct(*columns).alias("_new"))
        put = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        return model.rows.join(own, model.key, "left").select(*(put(c) if c in columns else c for c in model.rows.columns))

    def deleted(self, name: str, permissions: Collection[str], keys: DataFrame) -> DataFrame:
        """The model's rows without those of `keys` that the caller sees."""
        model = self._checked(name, "delete", permissions)
        gone = self._rows(model, permissions).select(model.key).join(keys.select(model.key), model.key, "left_semi")
        return model.rows.join(gone, model.key, "left_anti")

    @staticmethod
    def _writable(model: Model, rows: DataFrame) -> None:
        wrong = [c for c in rows.columns if c not in model.rows.columns or c in model.readonly or c in model.hidden]
        if wrong or model.key not in rows.columns:
            raise ValueError(f"columns that can't be written {sorted(wrong)}, or no key {model.key}")


def _into(session: SparkSession, name: str, rows: DataFrame) -> None:
    """A view of a plan in another session of the same application."""
    plan = rows._jdf.queryExecution().analyzed()
    jvm = session._jvm
    frame = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)
    frame.createOrReplaceTempView(name)
