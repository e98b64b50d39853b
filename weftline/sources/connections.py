"""Connection managers: reading connection files and telling server and database of a reference."""

from __future__ import annotations

import re
import socket
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.sources.packages import attribute, every

# Names of the server and of the database in connection strings.
SERVER_KEYS = ["data source", "server", "address", "addr", "network address"]
DATABASE_KEYS = ["initial catalog", "database"]


def parts(connection: str) -> dict[str, str]:
    """The settings of a connection string by lower-case name."""
    return {k.strip().lower(): v.strip().strip("\"'") for k, _, v in (p.partition("=") for p in (connection or "").split(";")) if k.strip() and v.strip()}


def server_and_database(connection: str) -> tuple[str, str]:
    """(server, database) of a connection string, empty where it doesn't say."""
    known = parts(connection)
    pick = lambda keys: next((known[k] for k in keys if k in known), "")
    return pick(SERVER_KEYS), pick(DATABASE_KEYS)


def server_column(connection: Column) -> Column:
    """The server of a column of connection strings."""
    return F.regexp_extract(connection, r"(?i)(?:^|;)\s*(?:data source|server|address|addr|network address)\s*=\s*([^;]*)", 1)


def database_column(connection: Column) -> Column:
    """The database of a column of connection strings."""
    return F.regexp_extract(connection, r"(?i)(?:^|;)\s*(?:initial catalog|database)\s*=\s*([^;]*)", 1)


def looks_like_sql(text: str) -> bool:
    """Whether a text is a connection string of a database."""
    return bool(re.search(r"(?i)(data source|server|initial catalog|database)\s*=", text or ""))


def normalized(connection: str) -> str:
    """A connection string without its provider, in the names of the SQL client."""
    known = {k: v for k, v in parts(connection).items() if k not in ("provider", "auto translate", "application name")}
    server, database = server_and_database(connection)
    rest = {k: v for k, v in known.items() if k not in SERVER_KEYS + DATABASE_KEYS}
    return ";".join([f"Data Source={server}", f"Initial Catalog={database}", *[f"{k}={v}" for k, v in rest.items()], "TrustServerCertificate=True"])


def reachable(connection: str, timeout: float = 3.0) -> tuple[bool, str]:
    """Whether a server answers at the address of a connection string, and what was tried or went wrong.

    No login is made and nothing is sent. Without a server nothing is tried.
    """
    server = server_and_database(connection)[0].split("\\")[0]
    host, _, port = server.removeprefix("tcp:").partition(",")
    if not host.strip():
        return False, "no server"
    address = (host.strip() if host.strip() != "." else "localhost", int(port) if port.strip().isdigit() else 1433)
    try:
        with socket.create_connection(address, timeout):
            return True, f"{address[0]},{address[1]}"
    except OSError as e:
        return False, f"{address[0]},{address[1]}: {e}"


class Connections:
    """Connection strings by name and id; connection files go before those inside packages."""

    def __init__(self, overrides: dict[str, str] | None = None) -> None:
        self.overrides = {k.lower(): v for k, v in (overrides or {}).items()}
        self.known: dict[str, str] = {}

    def add(self, names: list[str], connection: str, overwrite: bool) -> None:
        for n in filter(None, names):
            if overwrite or n.lower() not in self.known:
                self.known[n.lower()] = connection

    def scan(self, folder: str) -> None:
        """Read all connection files and packages below a folder; unreadable files are passed over."""
        for suffix, overwrite in (("*.conmgr", True), ("*.dtsx", False)):
            for file in sorted(Path(folder).rglob(suffix)):
                try:
                    root = ET.fromstring(file.read_bytes())
                except ET.ParseError:
                    continue
                owners = [root] if overwrite else [c for c in every(root, "ConnectionManager") if attribute(c, "ObjectName")]
                for owner in owners:
                    found = next((attribute(c, "ConnectionString") for c in owner.iter() if attribute(c, "ConnectionString")), "") or next(((c.text or "") for c in owner.iter() if attribute(c, "Name") == "ConnectionString"), "")
                    if found:
                        self.add([attribute(owner, "ObjectName"), attribute(owner, "DTSID"), attribute(owner, "refId"), *([file.stem] if overwrite else [])], found, overwrite)

    def resolve(self, reference: str) -> str | None:
        """The connection string of a reference: override, name, name in brackets, part of a name, itself."""
        low = (reference or "").lower()
        inner = re.search(r"\[([^\]]+)\]", low)
        names = [low, *([inner[1]] if inner else []), low.rsplit("\\", 1)[-1]]
        for table in (self.overrides, self.known):
            for n in names:
                if n in table:
                    return table[n]
        short = names[1] if inner else low
        for table in (self.overrides, self.known):
            for n, value in table.items():
                if short and (short in n or n in short):
                    return value
        return reference if looks_like_sql(reference) else None
