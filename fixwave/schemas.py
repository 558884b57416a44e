"""Schemas of the telemetry tables; the widest writer of each table decides."""

from __future__ import annotations

TIME = "decimal(16,6)"
_CHANNELS = range(1, 5)
_EST = (
    f"ID long, siteID long, timestamp {TIME}, frequency int, center int, fdsp double, "
    + ", ".join(f"fd{c}{p} double" for c in _CHANNELS for p in "ri")
    + ", band3 smallint, band10 smallint, edsp double, "
    + ", ".join(f"ed{c}{p} double" for c in _CHANNELS for p in "ri")
    + ", ec double, tnp double, "
    + ", ".join(f"nc{a}{b}{p} double" for a in _CHANNELS for b in _CHANNELS for p in "ri")
    + ", fdsnr double, edsnr double, deploymentID long"
)
_DDL: dict[str, str] = {
    "site": "ID long, name string, latitude decimal(10,6), longitude decimal(11,6), easting decimal(9,2), northing decimal(10,2), utm_zone_number smallint, utm_zone_letter string, elevation decimal(7,2)",
    "project": "ID long, name string, ownerID long, is_public boolean, is_hidden boolean",
    "auth_project_viewer": "projectID long, groupID long",
    "auth_project_collaborator": "projectID long, groupID long",
    "tx": "ID long, name string, serial_no string, tx_makeID long, projectID long, frequency double, is_hidden boolean",
    "tx_make": "ID long, manufacturer string, model string, demod_type string",
    "tx_parameters": "ID long, txID long, name string, value string",
    "tx_make_parameters": "ID long, tx_makeID long, name string, value string",
    "target": "ID long, name string, projectID long, max_speed_family string, speed_burst double, speed_sustained double, speed_limit double, is_hidden boolean",
    "location": "ID long, name string, projectID long, latitude decimal(10,6), longitude decimal(11,6), easting decimal(9,2), northing decimal(10,2), is_hidden boolean",
    "deployment": f"ID long, name string, time_start {TIME}, time_end {TIME}, txID long, targetID long, projectID long, is_active boolean, is_hidden boolean",
    "afsk": f"ID long, siteID long, timestamp {TIME}, message string, binary_data binary",
    "est": _EST,
    "estscore": "estID long, score int, max_score int, theoretical_score int",
    "estinterval": f"ID long, deploymentID long, siteID long, timestamp {TIME}, duration double, pulse_interval double, pulse_variation double",
    "telemetry": f"siteID long, datetime timestamp_ntz, timezone string, timestamp {TIME}, ping_power int, ping_computer int, site_status int, internal_temp double, external_temp double, voltage double",
    "timecheck": f"siteID long, datetime timestamp_ntz, timezone string, timestamp {TIME}, time_offset double",
    "detcount": f"siteID long, datetime timestamp_ntz, timezone string, timestamp {TIME}, detcount int",
    "estcount": f"siteID long, datetime timestamp_ntz, timezone string, timestamp {TIME}, estcount int",
    "procount": f"siteID long, datetime timestamp_ntz, timezone string, timestamp {TIME}, procount int",
    "calibration_information": "ID long, name string, description string",
    "gps_data": "ID long, deploymentID long, timestamp int, latitude decimal(10,6), longitude decimal(11,6), elevation decimal(7,2), easting decimal(9,2), northing decimal(10,2), zone string",
    "true_position": "estID long, easting double, northing double, elevation double, `2d_distance` double, `3d_distance` double, bearing double, elevation_angle double",
    "steering_vectors": "ID long, cal_infoID long, siteID long, bearing decimal(5,2), " + ", ".join(f"sv{c}{p} double" for c in _CHANNELS for p in "ri"),
    "bearing": f"ID long, deploymentID long, siteID long, timestamp {TIME}, bearing double, likelihood double, activity double, number_est_used int",
    "position": f"ID long, deploymentID long, timestamp {TIME}, latitude decimal(10,6), longitude decimal(11,6), easting decimal(9,2), northing decimal(10,2), utm_zone_number smallint, utm_zone_letter string, likelihood double, activity double, number_est_used int",
    "covariance": "positionID long, status string, method string, cov11 double, cov12 double, cov21 double, cov22 double, lambda1 double, lambda2 double, alpha double, w99 double, w95 double, w90 double, w80 double, w68 double",
    "track_pos": f"ID long, positionID long, deploymentID long, timestamp {TIME}",
    "provenance": "obj_table string, obj_id long, dep_table string, dep_id long",
    "processing_cursor": "name string, value long",
    "processing_statistics": "ID long, start_time double, duration double, process string, first_id long, last_id long, num_input long, num_output long",
    "archive_log": "ID long, table_name string, file_name string, first_id long, last_id long, n_rows long, first_time double, last_time double",
    "archive_config": "table_name string, last_id long, archive boolean",
    "movebank_export": "deploymentID long, last_export double, interval_s double, enabled boolean",
}

TABLES = dict(_DDL)
KEYS = {name: next((c for c in (f.split()[0] for f in ddl.split(", ")) if c in ("ID", "estID", "positionID", "deploymentID", "name")), None) for name, ddl in _DDL.items()}
