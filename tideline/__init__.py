"""Mark-recapture and survey-effort analytics over sightings tables, as Spark DataFrame functions."""
