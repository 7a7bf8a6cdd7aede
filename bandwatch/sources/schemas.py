"""Explicit schemas of the survey tables.

Times are integer microseconds (``*_us``), so that exposure adds up exactly
whatever the order of summation. Intervals are half-open.
"""

from __future__ import annotations

FIX = (
    "struct<latitude:double,longitude:double,altitude_m:double,manual:boolean,"
    "utc_us:bigint,monotonic_us:bigint,source:string,hdop:double,satellites:int>"
)

TABLES: dict[str, str] = {
    "sessions": "session_id bigint, source string, title string, complete boolean, elapsed_us bigint, "
    "input_us bigint, measurement_us bigint, delivered bigint, dropped bigint",
    "acquisitions": "session_id bigint, acq_id bigint, start_us bigint, end_us bigint, finalized boolean, "
    "center_hz bigint, sample_rate bigint, span_hz bigint, threshold_dbfs double, offset_hz bigint, "
    "lna int, vga int, amp boolean, rtl_gain_db double, rtl_auto boolean",
    # activity holds, per frame, the ascending active bins: the bitmap made sparse,
    # so quiet cells cost nothing and busy queries never read the power arrays.
    "tiles": "session_id bigint, acq_id bigint, tile_id bigint, first_sample bigint, end_sample bigint, "
    "start_us bigint, end_us bigint, utc_start_us bigint, utc_end_us bigint, power_start_us bigint, "
    "power_end_us bigint, first_center_hz double, bin_width_hz double, fft_size int, frame_count int, "
    "bin_count int, background_dbfs double, clipped bigint, quality int, mean_dbfs array<double>, "
    f"peak_dbfs array<double>, activity array<array<int>>, fix_start {FIX}, fix_end {FIX}",
    "events_energy": "session_id bigint, event_id bigint, first_sample bigint, end_sample bigint, start_us bigint, "
    "end_us bigint, utc_start_us bigint, utc_end_us bigint, lower_hz double, upper_hz double, active_us bigint, "
    f"mean_dbfs double, peak_dbfs double, quality int, fix_start {FIX}, fix_end {FIX}",
    "coverage_gaps": "session_id bigint, gap_id bigint, missing_samples bigint, utc_start_us bigint, "
    "utc_end_us bigint, start_us bigint, end_us bigint, reason string",
    "positions": "session_id bigint, seq bigint, latitude double, longitude double, altitude_m double, "
    "manual boolean, valid boolean, utc_us bigint, monotonic_us bigint, source string, hdop double, satellites int",
    "waveforms": "session_id bigint, waveform_id bigint, version bigint, center_hz double, bandwidth_hz int, "
    "spreading_factor int, first_observed_us bigint, delimiter_us bigint, delimiter_utc_us bigint, "
    "up_match double, down_match double, contributing_subbands int, complete_in_range boolean, "
    f"ambiguous boolean, fix {FIX}",
    "receptions": "session_id bigint, reception_id bigint, utc_us bigint, elapsed_us bigint, frequency_hz bigint, "
    "bandwidth_hz int, spreading_factor int, coding_rate int, duration_us bigint, snr_db double, "
    "frequency_error_hz double, header_valid boolean, crc_valid boolean, lane_label string, status int, "
    f"classification string, evidence_port int, evidence_signature boolean, fix {FIX}",
    "rssi_scans": "session_id bigint, scan_id bigint, board int, frequency_hz bigint, filter_hz int, "
    "rssi_offset_db double, utc_start_us bigint, utc_end_us bigint, start_us bigint, end_us bigint, "
    f"counts array<bigint>, fix {FIX}",
    "iq_blocks": "session_id bigint, first_sample bigint, encoding string, iq array<double>",
    "nmea_sentences": "session_id bigint, seq bigint, received_monotonic_us bigint, received_utc_us bigint, "
    "sentence string",
    "discovery_bands": "session_id bigint, acq_id bigint, subband int, center_hz double, processed_samples bigint, "
    "abandoned_samples bigint, gap_samples bigint, candidate_limit_hits bigint, track_limit_hits bigint",
    "discovery_status": "session_id bigint, acq_id bigint, enabled boolean, finished boolean, failed boolean, method string, "
    "fault string, accepted_input_samples bigint, rejected_input_samples bigint, channelized_input_samples bigint, "
    "abandoned_input_samples bigint, source_queue_drops bigint, stream_resets bigint, result_overflows bigint, "
    "gap_overflows bigint, observations bigint",
    "checkpoints": "session_id bigint, at_us bigint, state string, input_us bigint, measured_us bigint, dropped_samples bigint",
    "lane_status": "session_id bigint, lane_label string, board int, at_us bigint, frames bigint, classified bigint, "
    "crc_failures bigint, processed_us bigint",
    "decoder_status": "session_id bigint, acq_id bigint, available boolean, enabled boolean, finished boolean, "
    "candidates bigint, started bigint, completed bigint, crc_valid bigint, classified bigint, history_misses bigint, "
    "active_limit_hits bigint, duplicate_candidates bigint, excluded_candidates bigint, outside_range_candidates bigint, "
    "unsupported_candidates bigint, timeouts bigint, resets bigint, abandoned_decoders bigint, frame_overflows bigint, "
    "active_decoders bigint, history_samples bigint",
    # The compact layout: tiles that refer to power blocks and fixes, see operators/compact.py.
    "compact_tiles": "session_id bigint, acq_id bigint, tile_id bigint, first_sample bigint, end_sample bigint, "
    "start_us bigint, end_us bigint, utc_start_us bigint, utc_end_us bigint, first_center_hz double, "
    "bin_width_hz double, fft_size int, frame_count int, bin_count int, background_dbfs double, clipped bigint, "
    "quality int, activity array<array<int>>, power_id bigint, start_fix bigint, end_fix bigint",
    "power_blocks": "session_id bigint, power_id bigint, first_center_hz double, bin_width_hz double, fft_size int, "
    "bin_count int, first_sample bigint, end_sample bigint, start_us bigint, end_us bigint, utc_start_us bigint, "
    "utc_end_us bigint, frame_count bigint, mean_dbfs array<double>, peak_dbfs array<double>",
    "fixes": "session_id bigint, fix_id bigint, latitude double, longitude double, altitude_m double, manual boolean, "
    "utc_us bigint, monotonic_us bigint, source string, hdop double, satellites int",
    "discovery_gaps": "session_id bigint, gap_id bigint, first_input_sample bigint, end_input_sample bigint, "
    "subband int, reason string",
}
