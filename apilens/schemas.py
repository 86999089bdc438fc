"""Canonical schemas of stored tables and exchanged documents."""

from __future__ import annotations

PACKETS = "ts timestamp, node string, iface string, packet binary"

SEGMENTS = (
    "ts timestamp, node string, iface string, src_ip string, src_port int, dst_ip string, "
    "dst_port int, seq bigint, payload binary"
)

HTTP_MESSAGES = (
    "id string, type string, ts timestamp, node string, service string, method string, "
    "endpoint string, full_url string, host string, protocol string, status_code int, "
    "status_text string, source_ip string, source_port int, destination_ip string, "
    "destination_port int, request_headers map<string,string>, request_body string, "
    "response_headers map<string,string>, response_body string, version string"
)

# A capture record as written to a capture file; the time is text in the file.
CAPTURE_RECORD = (
    "id string, type string, timestamp string, node string, service string, method string, "
    "endpoint string, full_url string, host string, protocol string, status_code int, "
    "status_text string, source_ip string, source_port int, destination_ip string, "
    "destination_port int, request_headers map<string,string>, request_body string, "
    "response_headers map<string,string>, response_body string, version string"
)

SERVICE_MAPPINGS = "service string, appId string, instanceId string"

SERVICE_CONFIG = (
    "apiKey string, autoOnboardNewServices boolean, "
    "serviceMappings map<string, struct<appId:string, instanceId:string>>"
)

CATALOG_LISTING = (
    "endpointGroups array<struct<endpoints: array<struct<method:string, path:string, id:string>>>>"
)

CATALOG = (
    "appId string, instanceId string, endpoint_id string, method string, path string, "
    "body_example string"
)

APPLICATION_LISTING = (
    "applications array<struct<applicationId:string, applicationName:string, "
    "instances:array<struct<instanceId:string, instanceName:string>>>>, nextToken string"
)

PODS = "ip string, namespace string, name string, labels map<string,string>"

K8S_SERVICES = "cluster_ip string, namespace string, name string"
