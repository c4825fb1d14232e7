"""Shared by the tests of this folder; not named conftest, so that no other folder's can stand in."""

SF_SMALL = "/root/testdata/sf0.001"
