"""Trigonometry in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def tand(x: Column) -> Column:
    return F.tan(F.radians(x))


def atand(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))
