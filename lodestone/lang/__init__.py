"""The source language: parsing to relations, rule detectors, suppression. Domain words live only here."""
