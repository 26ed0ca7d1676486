"""Image operators: functions from pixel relations to pixel relations or to aggregates."""
