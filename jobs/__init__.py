"""Jobs that run on their own: `python -m jobs.text_catalogue --help`, `python -m jobs.orbit_weather --help`."""
