"""Service configuration: strict JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

from eventloom.model import Contract, EventError, ServiceIdentity

_FIELDS = {"service_name": str, "instance_id": str, "listen_address": str, "wal_path": str, "contracts": list}
_CONTRACT_FIELDS = {"source_service": str, "event_types": list, "peer_address": str}


@dataclass(frozen=True)
class ServiceConfig:
    identity: ServiceIdentity
    contracts: tuple[Contract, ...]
    wal_path: str


def _strict(found, fields: dict, where: str) -> dict:
    if not isinstance(found, dict) or set(found) != set(fields):
        raise EventError(f"{where}: needs exactly the fields {', '.join(fields)}")
    for name, kind in fields.items():
        if not isinstance(found[name], kind):
            raise EventError(f"{where}: {name} has the wrong type")
    return found


def parse_config(text: str) -> ServiceConfig:
    """Unknown and missing fields are errors, as is an empty text."""
    try:
        whole = _strict(json.loads(text), _FIELDS, "configuration")
    except json.JSONDecodeError as broken:
        raise EventError(f"configuration: {broken}") from broken
    contracts = []
    for entry in whole["contracts"]:
        own = _strict(entry, _CONTRACT_FIELDS, "contract")
        if not all(isinstance(t, str) for t in own["event_types"]):
            raise EventError("contract: event types are strings")
        contracts.append(Contract(own["source_service"], tuple(own["event_types"]), own["peer_address"]))
    identity = ServiceIdentity(whole["service_name"], whole["instance_id"], whole["listen_address"])
    return ServiceConfig(identity, tuple(contracts), whole["wal_path"])


def load_config(path: str) -> ServiceConfig:
    with open(path, encoding="utf-8") as file:
        return parse_config(file.read())


def parse_address(address: str) -> tuple[str, int]:
    """Host and port; the port is 0 if none is given."""
    host, _, port = address.partition(":")
    parts = host.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise EventError(f"no IPv4 address: {address}")
    if port and (not port.isdigit() or int(port) > 65535):
        raise EventError(f"no port: {address}")
    return host, int(port or 0)
