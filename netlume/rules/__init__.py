"""The rule language: parsing, matching, and rules of several parts."""
