"""Rotorline: fleet telemetry analytics for industrial motors, written for Spark."""
