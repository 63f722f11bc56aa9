"""Capabilities: who may read or write which namespace.

Decided on the driver before a plan is built, or as a semi-join where many
callers are judged at once.  Grants count only if the namespace's owner
issued them, and delegations spend their budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Actions of consents and scopes of delegations.
CONSENT_ACTIONS = ("CrossNamespaceRead", "AgentQueryAccess", "ExportData", "ShareNamespaceKey", "PurgeNamespace", "GrantWriteAccess")
SCOPES = ("ReadNamespace", "WriteNamespace", "CrossNamespaceQuery", "CreateNamespace", "ManageBranches", "Full")


@dataclass
class Consent:
    action: str
    consenter: str
    target: str
    namespace: str | None = None  # None: all of the consenter's
    expires_at_ms: int | None = None

    def covers(self, action: str, target: str, namespace: str, now_ms: int) -> bool:
        return self.action == action and self.target == target and self.namespace in (None, namespace) and (self.expires_at_ms is None or now_ms < self.expires_at_ms)


@dataclass
class Delegation:
    delegation_id: str
    delegator: str
    delegate: str
    scopes: list[str]
    namespaces: list[str] = field(default_factory=list)  # none: all
    expires_at_ms: int | None = None
    max_queries: int | None = None
    queries_used: int = 0
    revoked: bool = False

    def is_valid(self, now_ms: int) -> bool:
        return not self.revoked and (self.expires_at_ms is None or now_ms < self.expires_at_ms) and (self.max_queries is None or self.queries_used < self.max_queries)

    def has_scope(self, scope: str) -> bool:
        return "Full" in self.scopes or scope in self.scopes

    def covers_namespace(self, namespace: str) -> bool:
        return not self.namespaces or namespace in self.namespaces


class AccessDenied(PermissionError):
    pass


class AccessControl:
    """``owners``: namespace to owner.  ``any_issuer`` accepts grants whoever issued them."""

    def __init__(self, owners: dict[str, str], any_issuer: bool = False):
        self.owners, self.any_issuer = owners, any_issuer
        self.consents: list[Consent] = []
        self.delegations: dict[str, Delegation] = {}

    def add_consent(self, c: Consent) -> None:
        self.consents.append(c)

    def add_delegation(self, d: Delegation) -> None:
        self.delegations[d.delegation_id] = d

    def revoke(self, delegation_id: str) -> bool:
        d = self.delegations.get(delegation_id)
        if d:
            d.revoked = True
        return d is not None

    def cleanup(self, now_ms: int) -> None:
        self.consents = [c for c in self.consents if c.expires_at_ms is None or now_ms < c.expires_at_ms]
        self.delegations = {k: d for k, d in self.delegations.items() if d.is_valid(now_ms)}

    def _issued(self, issuer: str, namespace: str) -> bool:
        return self.any_issuer or self.owners.get(namespace) == issuer

    def _check(self, caller: str, namespace: str, action: str, scope: str, now_ms: int) -> bool:
        if self.owners.get(namespace) == caller:
            return True
        if any(c.covers(action, caller, namespace, now_ms) and self._issued(c.consenter, namespace) for c in self.consents):
            return True
        for d in self.delegations.values():
            if d.delegate == caller and d.is_valid(now_ms) and d.has_scope(scope) and d.covers_namespace(namespace) and self._issued(d.delegator, namespace):
                d.queries_used += 1
                return True
        return False

    def check_read(self, caller: str, namespace: str, now_ms: int) -> bool:
        return self._check(caller, namespace, "CrossNamespaceRead", "ReadNamespace", now_ms)

    def check_write(self, caller: str, namespace: str, now_ms: int) -> bool:
        return self._check(caller, namespace, "GrantWriteAccess", "WriteNamespace", now_ms)

    def check_across(self, caller: str, namespaces: list[str], now_ms: int) -> bool:
        """One delegation must cover all; owners have no exemption here."""
        for d in self.delegations.values():
            if d.delegate == caller and d.is_valid(now_ms) and d.has_scope("CrossNamespaceQuery") and all(d.covers_namespace(n) and self._issued(d.delegator, n) for n in namespaces):
                d.queries_used += 1
                return True
        return False

    def require_read(self, caller: str | None, namespace: str | None, now_ms: int) -> None:
        if caller is None or namespace is None or not self.check_read(caller, namespace, now_ms):
            raise AccessDenied(f"{caller} may not read {namespace}")

    def require_across(self, caller: str | None, namespaces: list[str], now_ms: int) -> None:
        if caller is None or not self.check_across(caller, namespaces, now_ms):
            raise AccessDenied(f"{caller} may not query {namespaces} together")


def delegation_covers(namespace: Column, scope: str, now_ms: int) -> Column:
    """``Delegation`` validity, scope and coverage as a predicate on a delegation row."""
    valid = ~F.coalesce(F.col("revoked"), F.lit(False)) & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)) & (F.col("max_queries").isNull() | (F.col("queries_used") < F.col("max_queries")))
    return valid & (F.array_contains("scopes", scope) | F.array_contains("scopes", "Full")) & ((F.size("namespaces") == 0) | F.array_contains(F.col("namespaces"), namespace))


def allowed_namespaces(namespaces: DataFrame, consents: DataFrame, delegations: DataFrame, caller: str, now_ms: int, action: str = "CrossNamespaceRead", scope: str = "ReadNamespace") -> DataFrame:
    """``namespace``: those that ``caller`` owns, or may use by a consent to ``action`` or a delegation of ``scope`` from the owner."""
    own = namespaces.where(F.col("owner") == caller).select("id")
    c = consents.where((F.col("action") == action) & (F.col("target") == caller) & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)))
    by_consent = namespaces.join(c.select("consenter", F.col("namespace").alias("_ns")), (F.col("consenter") == F.col("owner")) & (F.col("_ns").isNull() | (F.col("_ns") == F.col("id")))).select("id")
    d = delegations.where(F.col("delegate") == caller).select("delegator", "scopes", "namespaces", "revoked", "expires_at_ms", "max_queries", "queries_used")
    by_delegation = namespaces.select("id", "owner").join(d, F.col("delegator") == F.col("owner")).where(delegation_covers(F.col("id"), scope, now_ms)).select("id")
    return own.union(by_consent).union(by_delegation).distinct().select(F.col("id").alias("namespace"))


def readable(records: DataFrame, namespaces: DataFrame, consents: DataFrame, delegations: DataFrame, caller: str, now_ms: int) -> DataFrame:
    """Records in namespaces that ``caller`` may read: a semi-join with the few namespaces allowed."""
    return records.join(allowed_namespaces(namespaces, consents, delegations, caller, now_ms), "namespace", "left_semi")


def writable(records: DataFrame, namespaces: DataFrame, consents: DataFrame, delegations: DataFrame, caller: str, now_ms: int) -> DataFrame:
    """Records that ``caller`` may write."""
    return records.join(allowed_namespaces(namespaces, consents, delegations, caller, now_ms, "GrantWriteAccess", "WriteNamespace"), "namespace", "left_semi")
