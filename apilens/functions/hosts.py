"""Service names from host names, and address predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Address prefixes of pods and of cluster services.
CLUSTER_PREFIXES = ("10.244.", "10.96.")

# One number as an IPv4 address: octal, hexadecimal or decimal, at most 32 bits.
_OCTAL = r"0+(?:[1-3][0-7]{10}|[0-7]{0,10})"
_HEX = r"0[xX]0*[0-9a-fA-F]{1,8}"
_DECIMAL = (
    r"[1-9][0-9]{0,8}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}"
    r"|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[01][0-9]{2}"
    r"|42949672[0-8][0-9]|429496729[0-5]"
)
NUMERIC_ADDRESS = rf"^(?:{_OCTAL}|{_HEX}|{_DECIMAL})$"


def host_label(host: Column) -> Column:
    """First label of the host, port left out."""
    return F.substring_index(F.substring_index(host, ":", 1), ".", 1)


def names_no_service(host: Column) -> Column:
    """True when the host is missing or its first label reads as an address."""
    return F.coalesce(host, F.lit("")).eqNullSafe("") | host_label(host).rlike(NUMERIC_ADDRESS)


def is_cluster_traffic(source_ip: Column, destination_ip: Column) -> Column:
    prefixes = "^(?:" + "|".join(p.replace(".", r"\.") for p in CLUSTER_PREFIXES) + ")"
    return source_ip.rlike(prefixes) | destination_ip.rlike(prefixes)


def is_inter_service(host: Column, destination_ip: Column) -> Column:
    """Host is a name inside the cluster: not the bare address, dotted, local or 2+ dots."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return (
        (host != destination_ip)
        & (dots >= 1)
        & (host.contains("svc.cluster.local") | (dots >= 2))
    )
