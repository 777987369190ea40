"""The table of sources that a new store begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Slug, name, country (null for sources of many countries) and kind of each source.
SOURCES = [
    ("autoscout24.de", "AutoScout24", None, "marketplace"),
    ("autotrader.nl", "AutoTrader.nl", "NL", "marketplace"),
    ("theparking.eu", "theParking", None, "agregador"),
    ("autoboerse.de", "Autobörse", "DE", "marketplace"),
    ("meinauto.de", "MeinAuto", "DE", "marketplace"),
    ("quoka.de", "Quoka", "DE", "particulares"),
    ("autohero.com", "Autohero", "DE", "rede_stands"),
    ("aramisauto.com", "Aramisauto", "FR", "rede_stands"),
    ("ooyyo.com", "Ooyyo", None, "agregador"),
    ("autoline.pt", "Autoline", "BE", "marketplace"),
    ("autocasion.com", "Autocasión", "ES", "marketplace"),
    ("ocasionplus.com", "OcasionPlus", "ES", "rede_stands"),
    ("flexicar.es", "Flexicar", "ES", "rede_stands"),
    ("coches.trovit.es", "Trovit", "ES", "agregador"),
    ("autouncle.de", "AutoUncle DE", "DE", "agregador"),
    ("autouncle.dk", "AutoUncle DK", "DK", "agregador"),
    ("autouncle.se", "AutoUncle SE", "SE", "agregador"),
    ("autouncle.it", "AutoUncle IT", "IT", "agregador"),
    ("autouncle.at", "AutoUncle AT", "AT", "agregador"),
    ("autouncle.es", "AutoUncle ES", "ES", "agregador"),
    ("autouncle.pl", "AutoUncle PL", "PL", "agregador"),
    ("autouncle.fi", "AutoUncle FI", "FI", "agregador"),
    ("autouncle.ro", "AutoUncle RO", "RO", "agregador"),
    ("autouncle.ch", "AutoUncle CH", "CH", "agregador"),
    ("autouncle.co.uk", "AutoUncle UK", "GB", "agregador"),
    ("autouncle.nl", "AutoUncle NL", "NL", "agregador"),
    ("autouncle.fr", "AutoUncle FR", "FR", "agregador"),
    ("standvirtual.com", "Standvirtual", "PT", "marketplace"),
    ("olx.pt", "OLX", "PT", "marketplace"),
    ("custojusto.pt", "CustoJusto", "PT", "marketplace"),
    ("auto.sapo.pt", "auto SAPO", "PT", "marketplace"),
    ("auto.pt", "Auto.pt", "PT", "marketplace"),
    ("piscapisca.pt", "PiscaPisca", "PT", "marketplace"),
    ("autouncle.pt", "AutoUncle", "PT", "agregador"),
    ("encontracarros.pt", "EncontraCarros", "PT", "agregador"),
    ("caetano.pt", "Caetano Usados", "PT", "rede_stands"),
    ("carplus.pt", "CarPlus", "PT", "rede_stands"),
    ("santogal.pt", "Santogal", "PT", "rede_stands"),
]


def sources(spark: SparkSession) -> DataFrame:
    """(slug, name, country, kind): a row for each source."""
    return spark.createDataFrame(SOURCES, "slug string, name string, country string, kind string")
