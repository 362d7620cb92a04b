"""Schemas of the relational tables and of the nested documents, and how they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the eight tables.
TABLES = {
    "user_profiles": "id string, email string, full_name string, role string, created_at timestamp, updated_at timestamp",
    "subscriptions": "id string, user_id string, stripe_customer_id string, stripe_subscription_id string, plan_type string, status string, current_period_start timestamp, current_period_end timestamp, minutes_included decimal(10,2), minutes_used decimal(10,2), created_at timestamp, updated_at timestamp",
    "videos": "id string, video_id string, user_id string, r2_key string, original_filename string, display_filename string, file_size_bytes long, duration_seconds decimal(10,2), resolution string, fps decimal(5,2), codec string, status string, deleted_at timestamp, uploaded_at timestamp, created_at timestamp, updated_at timestamp",
    "usage_records": "id string, user_id string, subscription_id string, video_id string, minutes_consumed decimal(10,2), billing_period_start timestamp, billing_period_end timestamp, created_at timestamp",
    "billing_history": "id string, user_id string, subscription_id string, stripe_invoice_id string, amount int, status string, invoice_url string, billing_period_start timestamp, billing_period_end timestamp, minutes_billed decimal(10,2), overage_amount int, created_at timestamp",
    "analysis_shares": "id string, user_id string, video_id string, share_token string, view_count int, expires_at timestamp, created_at timestamp, updated_at timestamp",
    "blog_posts": "id string, title string, slug string, excerpt string, content_key string, featured_image string, status string, tags array<string>, author string, author_id string, published_at timestamp, created_at timestamp, updated_at timestamp",
    "processing_jobs": "id string, runpod_job_id string, job_id string, job_type string, user_id string, video_id string, status string, current_step string, progress int, retry_count int, max_retries int, parent_job_id string, last_error string, created_at timestamp, started_at timestamp, completed_at timestamp",
}
# Allowed values of enumerated columns.
ENUMS = {
    ("user_profiles", "role"): ("user", "admin", "super_admin"),
    ("subscriptions", "plan_type"): ("FREE", "STARTER", "PRO", "ENTERPRISE"),
}
PLANS = "plan string, price_cents int, hours int, overage_cents_per_hour int"


# Fields of the summaries that workers publish.
SUMMARY = (
    "reprojection_error_pixels double, camera_height_meters double, focal_length_pixels double, total_points_available long, points_used long, total_processing_time double, "
    "poses_detected long, frames_processed long, position_frames long, artifacts_corrected long, ml_jumps_detected long, players_analyzed long"
)
POSE_SUMMARY = "total_poses_detected long, frames_processed long, model_device string, pose_analysis_summary struct<total_frames_with_poses: long, avg_poses_per_frame: double, player_detections: long>"
POSITION_SUMMARY = "frames_with_data long, total_ankle_detections long, player_0_detections long, player_1_detections long, tracking_method string, advanced_tracking boolean"
#: What a step leaves: its summaries, and parts that are open records, which stay variants.
RESULTS = (
    f"error string, message string, summary struct<{SUMMARY.replace(' ', ': ').replace(',: ', ', ')}>, detected_points variant, "
    "pose_summary struct<total_poses_detected: long, frames_processed: long, model_device: string, processing_info: variant, video_info: variant, court_points: variant, camera_info: variant, "
    "pose_analysis_summary: struct<total_frames_with_poses: long, avg_poses_per_frame: double, player_detections: long>>, "
    f"position_summary struct<{POSITION_SUMMARY.replace(' ', ': ').replace(',: ', ', ')}, tracking_quality: variant>, files array<struct<name: string, url: string>>"
)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def with_generated(subscriptions: DataFrame) -> DataFrame:
    """The two generated columns: minutes left and minutes over, never below zero."""
    left = F.col("minutes_included") - F.col("minutes_used")
    zero = F.lit(0).cast("decimal(10,2)")
    return subscriptions.withColumns({"minutes_remaining": F.greatest(zero, left).cast("decimal(10,2)"), "overage_minutes": F.greatest(zero, -left).cast("decimal(10,2)")})


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both after columns were added: what a side lacks is null."""
    return old.select("*").unionByName(new.select("*"), allowMissingColumns=True)


def enum_violations(df: DataFrame, table: str) -> DataFrame:
    """(column, violations) for the table's enumerated columns; null passes. One pass."""
    columns = {c: allowed for (t, c), allowed in ENUMS.items() if t == table}
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias(c) for c, allowed in columns.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])).alias("r")).select("r.*")
